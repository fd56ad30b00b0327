"""Many row tests of a layer in one scan: counts in one aggregate, first ids and top values of what failed in one more job.

A test is a condition on a row.  ``measure`` compiles the tests of a layer into one
aggregate (partial in each task, one row out), so the number of tests adds columns,
not jobs.  ``samples`` goes over the layer once more, only if a test failed: each row
gives a row for each test that it fails, ranked by id inside its test.  Spark drops
ranks above the limit in each task before it shuffles them, so what travels is the
limit times tests times tasks, however many rows fail.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowTest:
    """Rows where ``bad`` holds (null: not) fail; rows where ``of`` holds count; ``value``: what a failing row shows; ``extreme``: an aggregate."""

    name: Hashable
    bad: Column
    of: Column | None = None
    value: Column | None = None
    extreme: Column | None = None


@dataclass
class Outcome:
    bad: int
    of: int
    extreme: object = None
    ids: list = field(default_factory=list)
    #: (value, rows), the most frequent first
    top: list[tuple[str | None, int]] = field(default_factory=list)


def counted(df: DataFrame, tests: Sequence[RowTest]) -> DataFrame:
    """One row: the numbers of rows that fail (b0, b1, ...) and that count (n0, ...), and the extremes (x0, ...)."""
    out = []
    for i, t in enumerate(tests):
        out += [F.count_if(t.bad).alias(f"b{i}"), (F.count("*") if t.of is None else F.count_if(t.of)).alias(f"n{i}")]
        if t.extreme is not None:
            out.append(t.extreme.alias(f"x{i}"))
    return df.agg(*out)


def failing(df: DataFrame, id_col: str, tests: Sequence[RowTest]) -> DataFrame:
    """(test, id, value): a row for each row of df and each test that it fails; test is its number."""
    one = lambda i, t: F.when(t.bad, F.struct(F.lit(i).alias("test"), (F.lit(None) if t.value is None else t.value).cast("string").alias("value")))
    found = F.filter(F.array(*[one(i, t) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    return df.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("f")).select("f.test", "id", "f.value")


def samples(df: DataFrame, id_col: str, tests: Sequence[RowTest], limit: int, top: int = 6) -> DataFrame:
    """(test, value, rows, id, rank): the first ``limit`` distinct ids of each test (value null), and its ``top`` most frequent values (id null)."""
    rows = failing(df, id_col, tests)
    in_order = F.dense_rank().over(Window.partitionBy("test").orderBy("id"))
    ids = rows.where("id is not null").select("test", "id").withColumn("rank", in_order).where(F.col("rank") <= limit).distinct()
    ids = ids.select("test", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("rows"), "id", F.col("rank").cast("int").alias("rank"))
    shown = [i for i, t in enumerate(tests) if t.value is not None]
    if not shown:
        return ids
    often = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("rows"), "value"))
    values = rows.where(F.col("test").isin(shown)).groupBy("test", "value").agg(F.count("*").alias("rows")).withColumn("rank", often).where(F.col("rank") <= top)
    return ids.unionByName(values.select("test", "value", "rows", F.lit(None).cast(ids.schema["id"].dataType).alias("id"), F.col("rank").cast("int").alias("rank")))


def evaluate(df: DataFrame, id_col: str, tests: Sequence[RowTest], limit: int = 25, top: int = 6) -> dict[Hashable, Outcome]:
    """The outcome of each test: one job, and one more if a test failed."""
    if not tests:
        return {}
    r = counted(df, tests).head()
    out = {t.name: Outcome(r[f"b{i}"], r[f"n{i}"], r[f"x{i}"] if t.extreme is not None else None) for i, t in enumerate(tests)}
    bad = [t for t in tests if out[t.name].bad]
    if bad:
        for s in samples(df, id_col, bad, limit, top).orderBy("test", "rank").collect():
            o = out[bad[s.test].name]
            if s.id is not None:
                o.ids.append(s.id)
            else:
                o.top.append((s.value, s.rows))
    return out
