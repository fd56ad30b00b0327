"""Datasets: named tables of any Spark format, their inventory and catalog.

Paths are only ever read through Spark and Hadoop file systems, so a dataset may
lie in any store that the cluster reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import is_system, short_name

FORMATS = ("parquet", "csv", "json", "orc")


def read_table(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """One table; CSV comes with a header, all columns as text."""
    form = form or next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), "parquet")
    return spark.read.option("header", True).option("allowComments", True).format(form).load(path)


def discover(spark: SparkSession, root: str) -> dict[str, str]:
    """name -> path of the tables in a folder, by suffix, in name order; hidden entries are left out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        stem, _, suffix = name.rpartition(".")
        if suffix in FORMATS and stem and not name.startswith((".", "_")):
            found[stem] = s.getPath().toString()
    return dict(sorted(found.items()))


def discover_datasets(spark: SparkSession, root: str) -> list[dict]:
    """The datasets below a path, in path order: folders that hold tables, and GeoPackage files, with their tables and bytes.

    Breadth first through the folders of any store that Hadoop reads.  A table (a file or folder with the suffix of a
    format) is not entered, only measured; hidden folders and files are left out.
    """
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(start):
        return []
    found, level = [], [fs.getFileStatus(start)]
    while level:
        below = []
        for folder in level:
            tables, size = [], 0
            for s in fs.listStatus(folder.getPath()) if folder.isDirectory() else [folder]:
                name = s.getPath().getName()
                stem, _, suffix = name.rpartition(".")
                if name.startswith((".", "_")):
                    continue
                if suffix in FORMATS and stem:
                    tables.append(stem)
                    size += fs.getContentSummary(s.getPath()).getLength()
                elif suffix.lower() == "gpkg" and s.isFile():
                    found.append({"path": s.getPath().toString(), "kind": "geopackage", "tables": [], "bytes": s.getLen()})
                elif s.isDirectory():
                    below.append(s)
            if tables:
                found.append({"path": folder.getPath().toString(), "kind": "folder", "tables": sorted(tables), "bytes": size})
        level = below
    return sorted(found, key=lambda d: d["path"])


class Dataset:
    """Lazily read tables, found by name in any case.  A table that cannot be read has its error in ``errors``."""

    def __init__(self, spark: SparkSession, name: str, frames: Mapping[str, DataFrame], catalog: Mapping[str, DataFrame] | None = None, errors: Mapping[str, str] | None = None, geometry: Mapping[str, str] | None = None):
        self.spark, self.name, self.frames, self.catalog, self.errors = spark, name, dict(frames), dict(catalog or {}), dict(errors or {})
        #: layer -> kind (point, line, polygon); its shape is in the column ``geometry``
        self.geometry = dict(geometry or {})
        self._layers: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: Iterable[str] | None = None) -> Dataset:
        paths = {n: f"{path}/{n}.parquet" for n in names} if names is not None else discover(spark, path)
        if not paths:
            raise ValueError(f"no tables in {path}")
        frames, errors = {}, {}
        for n, p in paths.items():
            try:
                frames[n] = read_table(spark, p)
            except Exception as e:  # a broken table is a finding, not the end of the run
                errors[n] = str(e)[:300]
        return cls(spark, path.rstrip("/").rpartition("/")[2], frames, errors=errors)

    def layer(self, name: str) -> DataFrame | None:
        return next((f for n, f in self.frames.items() if n.lower() == name.lower()), None)

    def fields(self) -> DataFrame:
        """(layer, field, type) from the schemas."""
        rows = [(n, f.name, f.dataType.simpleString()) for n, df in self.frames.items() for f in df.schema]
        return self.spark.createDataFrame(rows, "layer string, field string, type string")

    def layers(self) -> DataFrame:
        """(layer, rows, fields, system, readable): one job counts all tables; parquet counts come from footers."""
        if self._layers is None:
            parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("layer"), F.col("rows"), F.lit(len(df.columns)).cast("long").alias("fields"), F.lit(True).alias("readable")) for n, df in self.frames.items()]
            parts += [self.spark.createDataFrame([(n, 0, 0, False)], "layer string, rows long, fields long, readable boolean") for n in self.errors]
            out = reduce(DataFrame.unionByName, parts)
            self._layers = out.withColumn("system", is_system(F.col("layer")))
        return self._layers


def summary(layers: DataFrame) -> DataFrame:
    """One row: layers, system tables, empty and unreadable layers, rows in all."""
    return layers.agg(
        F.count_if(~F.col("system")).alias("layers"), F.count_if("system").alias("system_tables"), F.count_if(F.col("readable") & (F.col("rows") == 0)).alias("empty"),
        F.count_if(~F.col("readable")).alias("unreadable"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum("fields"), F.lit(0)).cast("long").alias("fields"),
    )


def data_layers(layers: DataFrame, annotation: Column | None = None) -> DataFrame:
    """Layers to check: no system tables, readable, not empty, no annotation."""
    out = layers.where(~F.col("system") & F.col("readable") & (F.col("rows") > 0))
    return out if annotation is None else out.where(~annotation)


def read_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df with the ids of (id, pos), in the order of ``pos``, the requested place; an id asked for twice comes twice, a missing one not at all."""
    return df.join(ids.withColumnRenamed("id", id_col), id_col).orderBy("pos")


def catalog_items(items: DataFrame, types: DataFrame) -> DataFrame:
    """Items (name, type) with the name of their type (uuid, label), or the raw type where there is none, and their short name."""
    return items.join(types, items["type"] == types["uuid"], "left").select("name", short_name(F.col("name")).alias("short_name"), F.coalesce("label", "type").alias("kind"))


def missing_tables(registered: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, severity, reason) of registered tables (name, has_cdf, has_table) that are not listed (layer)."""
    gone = registered.withColumn("k", F.lower("name")).join(listed.select(F.lower("layer").alias("k")).distinct(), "k", "left_anti").where("name is not null and name <> '' and not upper(name) like 'GDB!_%' escape '!'")
    view = F.lower("name").startswith("view_")
    reason = F.when(view, "view").when(F.col("has_cdf"), "compressed").when(~F.col("has_table"), "table file missing").otherwise("could not be opened")
    return gone.select("name", F.when(view | F.col("has_cdf"), "info").otherwise("error").alias("severity"), reason.alias("reason"))


def folder_rollup(paths: DataFrame, least: int = 2) -> DataFrame:
    """(folder, n) of the folders that hold at least ``least`` of the paths, unless a parent holds just the same ones.

    paths: (path) with ``/``.  Ancestors are exploded, counted with map-side sums, and compared with their parents by an anti join.
    """
    parts = paths.select(F.filter(F.split("path", "/"), lambda s: s != "").alias("p")).where(F.size("p") > 1)
    ancestors = parts.select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p").select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("folder"))
    n = ancestors.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    up = n.select(F.col("folder").alias("parent"), F.col("n").alias("m"))
    parent = F.when(F.instr("folder", "/") > 0, F.regexp_replace("folder", "/[^/]*$", ""))
    return n.withColumn("up", parent).join(up, (F.col("up") == F.col("parent")) & (F.col("n") == F.col("m")), "left_anti").select("folder", "n")


def dataset_kind(names: Iterable[str], networks: bool, path: str) -> str:
    """Which kind of dataset the table names show; the first that fits."""
    names = list(names)
    if networks:
        return "built network"
    if any(n.startswith(("B_", "C_", "A_")) for n in names):
        return "asset package"
    if "migration" in path.lower() and any(n.lower().startswith(("w", "e_", "ss")) for n in names):
        return "migration input"
    return "plain"
