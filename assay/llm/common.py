"""What the operators share: scratch tables, safe input columns, the split of ids, components."""

from __future__ import annotations

import ctypes
import functools
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="assay-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_table(spark: SparkSession) -> str:
    """A path for a scratch table; all of an application's are in one folder of the scratch directory."""
    return f"{scratch_dir(spark)}/assay-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once, written to the shared scratch folder and read from there: lost executors cost nothing and lineage ends here."""
    path = path or new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that are not written yet need them."""
    remove(spark, new_table(spark).rpartition("/")[0])


#: Bytes of an Arrow batch, at most, unless one row is longer.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES: what a Python worker and its JVM hold of a table with long rows is a few batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower())
    if size and int(size[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_memory() -> None:
    """Gives the free memory of a Python worker, which Spark keeps for later tasks, back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with free_memory at the end of a task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return task


def text_udf(kind: str, value: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """value, an Arrow function of a text column, as a column function; only that column travels to Python."""

    @F.arrow_udf(kind)
    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for t in texts:
                yield value(t)
        finally:
            free_memory()

    return task


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns (in any case) whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def same_columns(docs: DataFrame, names: Iterable[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with the columns of docs alone; those that step would replace, named like ``names`` in any case, come through unharmed."""
    taken = {n.lower() for n in names}
    safe = {c: f"__kept_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return step(docs.withColumnsRenamed(safe)).select(*[F.col(f"`{k.replace('`', '``')}`").alias(c) for c, k in safe.items()])


def shielded(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """step(docs, ...), whose own helper columns begin with ``__``: columns of docs that begin so come through unharmed under other names."""

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        names = {c: f"kept_{'_' * max(len(x) for x in docs.columns)}{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not names:
            return step(docs, *args, **more)
        given = inspect.signature(step).bind(docs.withColumnsRenamed(names), *args, **more)
        given.apply_defaults()
        for k, v in given.arguments.items():
            if k.endswith("_col"):
                given.arguments[k] = names.get(v, v)
        return step(*given.args, **given.kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def remainder(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def buckets(spark: SparkSession) -> int:
    """Into how many parts an operator deals out packed rows: four for each shuffle partition, so that chance evens them out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stars(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which has none itself: then no step changes anything."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return not many.unionByName(edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")).limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: rows (node, component), component being the smallest node reached.

    Alternates large-star and small-star steps until all are stars (rounds grow
    with the logarithm of the longest chain); each step is one shuffle by node with
    map-side minima, and each round's edges go to a scratch table.  Stars around one
    hot node are split by Spark's skew join because only (node, minimum) pairs meet.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = new_table(edges.sparkSession)
    e = materialise(e, path)
    while not _stars(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        before, path = path, new_table(edges.sparkSession)
        e = materialise(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), path)
        remove(edges.sparkSession, before)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
