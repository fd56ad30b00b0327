"""References between tables: rows whose ends point at nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.text import guid


def known_ids(*frames: tuple[DataFrame, str]) -> DataFrame:
    """(id): the distinct normalised ids of several tables."""
    out = None
    for df, col in frames:
        part = df.select(guid(F.col(f"`{col}`").cast("string")).alias("id")).where("id is not null")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def orphans(df: DataFrame, ends: Sequence[str], known: DataFrame) -> DataFrame:
    """The rows of df with an end that is null or not in known (id).

    Each end is looked up once for each distinct value, so a hot value is one row
    of the lookup; joins back are plain equi-joins that Spark may split.
    """
    out, tests = df, F.lit(False)
    for i, c in enumerate(ends):
        values = df.select(F.col(c).alias(f"__v{i}")).where(F.col(c).isNotNull()).distinct()
        values = values.withColumn("id", guid(F.col(f"__v{i}").cast("string"))).join(known.select("id"), "id", "left_semi").select(f"__v{i}", F.lit(True).alias(f"__k{i}"))
        out = out.join(values, F.col(c) == F.col(f"__v{i}"), "left")
        tests = tests | F.col(f"__k{i}").isNull()
    return out.where(tests).select(*df.columns)


def absent(names: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """Rows of names whose key, in any case, is not listed."""
    return names.withColumn("__k", F.lower(key)).join(listed.select(F.lower(key).alias("__k")).distinct(), "__k", "left_anti").drop("__k")
