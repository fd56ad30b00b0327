"""GeoPackage files (SQLite) as a Spark source, and as a dataset with its catalog.

``spark.read.format("geopackage")`` reads one table of a file: options ``path``,
``table``, ``columns`` (comma-separated; only these are fetched) and ``rows`` (row ids
in a partition, 100,000 unless given).  Partitions are ranges of the row id, which is
the table's B-tree key, so each task seeks to its range and streams it in Arrow
batches; a view or a table without row ids is one partition.

SQLite opens files, not streams.  ``open_dataset`` hands the file to Spark, which
copies it from whatever store it lies in to each executor once; tasks open their own
copy read-only.  A path given straight to the reader must be one that all executors see.

Declared types decide (SQLite stores anything anywhere); a value that does not fit its
column is null.  Geometry is WKB, without the header that the format puts before it.
"""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from assay.sources.dataset import Dataset

#: Rows of an Arrow batch.
BATCH = 2_000
# Geometry types of the format, its own tables, and bytes of the envelopes that its header may hold.
GEOMETRY = ("GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "CURVE", "SURFACE", "MULTICURVE", "MULTISURFACE")
OWN = ("gpkg_", "rtree_", "sqlite_")
ENVELOPE = (0, 32, 48, 48, 64)


def _local(path: str) -> str:
    """The file on this machine: Spark's copy if it was handed out, else the path itself."""
    copy = SparkFiles.get(os.path.basename(path))
    return copy if os.path.exists(copy) else path.removeprefix("file://").removeprefix("file:")


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(os.path.abspath(_local(path)))}?mode=ro&immutable=1", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str):
    """Spark's type of a declared one, by the format's names and SQLite's affinities."""
    name = declared.upper().split("(")[0].strip()
    if name in GEOMETRY or "BLOB" in name:
        return BinaryType()
    if name in ("BOOLEAN", "DATE", "DATETIME"):
        return {"BOOLEAN": BooleanType(), "DATE": DateType(), "DATETIME": TimestampType()}[name]
    if "INT" in name:
        return LongType()
    if any(k in name for k in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return DoubleType()
    return StringType()


def wkb(value: object) -> bytes | None:
    """The WKB in a geometry value; None if it is no geometry of the format."""
    if not isinstance(value, bytes) or len(value) < 8 or value[:2] != b"GP" or (value[3] >> 1) & 7 > 4:
        return None
    return value[8 + ENVELOPE[(value[3] >> 1) & 7] :] or None


def _fitting(kind):
    """value -> value of the type, or None."""

    def whole(v):
        return v if isinstance(v, int) and -(2**63) <= v < 2**63 else int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**63 else None

    def moment(v):
        try:
            t = dt.datetime.fromisoformat(v.strip().replace("Z", "+00:00"))
        except (AttributeError, ValueError):
            return None
        return t if t.tzinfo else t.replace(tzinfo=dt.UTC)

    def day(v):
        try:
            return dt.date.fromisoformat(v.strip()[:10])
        except (AttributeError, ValueError):
            return None

    return {
        LongType: whole, DoubleType: lambda v: float(v) if isinstance(v, int | float) else None, StringType: lambda v: None if v is None or isinstance(v, bytes) else str(v),
        BinaryType: lambda v: v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else None, BooleanType: lambda v: bool(v) if isinstance(v, int) else None, DateType: day, TimestampType: moment,
    }[type(kind)]


_ARROW = {LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary(), BooleanType: pa.bool_(), DateType: pa.date32(), TimestampType: pa.timestamp("us", "UTC")}


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> StructType:
        with closing(connect(self.options["path"])) as con:
            found = con.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        every = {name: StructField(name, kind_of(declared or ""), True) for _, name, declared, *_ in found}
        asked = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(every)
        return StructType([every[c] for c in asked])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema)


class Range(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.schema, self.rows = options["path"], options["table"], schema, int(options.get("rows", 100_000))
        if self.rows < 1:
            raise ValueError("rows must be 1 at least")

    def partitions(self) -> list[InputPartition]:
        with closing(connect(self.path)) as con:
            try:
                first, last = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # no row ids
                return [Range(None, None)]
        if not isinstance(first, int):  # a view has null ones, an empty table none
            return [Range(None, None)]
        return [Range(k, min(k + self.rows - 1, last)) for k in range(first, last + 1, self.rows)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with closing(connect(self.path)) as con:
            shaped = set()
            if con.execute("select 1 from sqlite_master where name = 'gpkg_geometry_columns'").fetchone():
                shaped = {r[0] for r in con.execute("select column_name from gpkg_geometry_columns where lower(table_name) = lower(?)", (self.table,))}
            fit = [wkb if f.name in shaped else _fitting(f.dataType) for f in self.schema]
            where, given = ("", ()) if part.first is None else (" where rowid between ? and ?", (part.first, part.last))
            rows = con.execute(f"select {', '.join(quoted(f.name) for f in self.schema)} from {quoted(self.table)}{where}", given)
            while some := rows.fetchmany(BATCH):
                columns = [pa.array([f(v) for v in c], _ARROW[type(k.dataType)]) for f, c, k in zip(fit, zip(*some, strict=True), self.schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def read(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    return spark.read.format("geopackage").options(path=path, table=table, **options).load()


def documents_of(metadata: DataFrame, reference: DataFrame) -> DataFrame:
    """(class, document) of metadata (id, metadata) and its references (pos, table_name, reference_scope, md_file_id).

    class is the table's name in lower case, or null for the whole file (scope ``geopackage``).  Of several documents of a
    class the one referred to last counts; references of another scope without a table are left out.
    """
    whole = F.col("reference_scope") == "geopackage"
    aimed = reference.select("pos", F.when(~F.coalesce(whole, F.lit(False)), F.lower("table_name")).alias("class"), F.coalesce(whole, F.lit(False)).alias("whole"), F.col("md_file_id").alias("id")).where("whole or class is not null and class <> ''")
    found = aimed.join(metadata.select("id", F.col("metadata").alias("document")), "id").groupBy("whole", "class").agg(F.max_by("id", F.struct("pos", "id")).alias("id"))
    return found.join(metadata.select("id", F.col("metadata").alias("document")), "id").select("class", "document")


def open_dataset(spark: SparkSession, path: str, name: str | None = None, rows: int = 100_000) -> Dataset:
    """The user tables of a GeoPackage with their geometry kinds, coordinate systems, metadata documents and class definitions."""
    spark.sparkContext.addFile(path)
    get = lambda table, **more: read(spark, path, table, rows=rows, **more)
    with closing(connect(path)) as con:  # names alone: the size of a schema
        tables = [t for (t,) in con.execute("select name from sqlite_master where type in ('table', 'view') order by name") if not t.lower().startswith(OWN)]
        own = {t for (t,) in con.execute("select name from sqlite_master where name like 'gpkg!_%' escape '!'")}
        shaped = con.execute("select table_name, column_name, geometry_type_name, z, m, srs_id from gpkg_geometry_columns").fetchall() if "gpkg_geometry_columns" in own else []
    by, frames, errors, kinds = {t.lower(): (c, g, z, m, s) for t, c, g, z, m, s in shaped}, {}, {}, {}
    for t in tables:
        try:
            frames[t] = get(t)
        except Exception as e:  # a broken table is a finding, not the end of the run
            errors[t] = str(e)[:300]
            continue
        if t.lower() in by:
            column, kind, z, m, _ = by[t.lower()]
            frames[t] = frames[t].withColumnRenamed(column, "geometry")
            kinds[t] = kind.lower() + (" z" if z else "") + (" m" if m else "")
    spatial = "Feature Class"
    items = spark.createDataFrame([(t, spatial if t in kinds else "Table") for t in frames], "name string, type string")
    catalog = {"items": items, "types": spark.createDataFrame([(k, k) for k in (spatial, "Table")], "uuid string, label string")}
    facts = spark.createDataFrame([(t, spatial if t in kinds else "Table", bool(by[t.lower()][2]) if t in kinds else None, bool(by[t.lower()][3]) if t in kinds else None) for t in frames], "class string, kind string, has_z boolean, has_m boolean")
    if {"gpkg_metadata", "gpkg_metadata_reference"} <= own:
        pos = F.row_number().over(Window.orderBy("timestamp", "md_file_id", "table_name"))  # a row for each reference of a schema
        reference = get("gpkg_metadata_reference", columns="reference_scope,table_name,timestamp,md_file_id").withColumn("pos", pos)
        documents = documents_of(get("gpkg_metadata", columns="id,metadata"), reference)
        facts = facts.join(documents.withColumnRenamed("class", "k"), F.lower("class") == F.col("k"), "left").select("class", "kind", F.col("document").alias("documentation"), "has_z", "has_m", F.lit(None).cast("double").alias("xy_tolerance"))
        catalog["workspace"] = documents.where("class is null").select(F.col("document").alias("documentation"))
    else:
        facts = facts.select("class", "kind", F.lit(None).cast("string").alias("documentation"), "has_z", "has_m", F.lit(None).cast("double").alias("xy_tolerance"))
    catalog["definitions"] = facts
    fields = [(t, spatial if t in kinds else "Table", f.name, f.dataType.simpleString(), None, True, False) for t, df in frames.items() for f in df.schema]
    catalog["class_fields"] = spark.createDataFrame(fields, "class string, kind string, field string, type string, domain string, nullable boolean, required boolean")
    if "gpkg_spatial_ref_sys" in own and kinds:
        placed = spark.createDataFrame([(t, by[t.lower()][4]) for t in kinds], "layer string, srs_id long")
        system = get("gpkg_spatial_ref_sys", columns="srs_id,definition").where("srs_id > 0")
        catalog["crs"] = placed.join(system, "srs_id", "left").select("layer", F.col("definition").alias("wkt"))
    return Dataset(spark, name or os.path.basename(path).rpartition(".")[0], frames, catalog, errors, kinds)
