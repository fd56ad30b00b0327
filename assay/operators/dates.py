"""Dates: the future, the distant past, spans and order, against a clock that the caller sets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import parse_dates

FLOOR = datetime(1850, 1, 1)


def as_date(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.col(name).cast("timestamp_ntz") if kind in ("timestamp_ntz", "timestamp", "date") else parse_dates(F.col(name))


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]


def date_sanity(df: DataFrame, columns: Sequence[str], as_of: datetime, floor: datetime = FLOOR) -> DataFrame:
    """(field, dated, future, latest, old, earliest) of each column: one scan; future is more than a day after as_of."""
    late, early = F.lit(as_of).cast("timestamp_ntz") + F.expr("interval 1 day"), F.lit(floor).cast("timestamp_ntz")
    wide = []
    for i, c in enumerate(columns):
        d = as_date(df, c)
        wide += [F.count(d).alias(f"n{i}"), F.count_if(d > late).alias(f"f{i}"), F.max(F.when(d > late, d)).alias(f"l{i}"), F.count_if(d < early).alias(f"o{i}"), F.min(F.when(d < early, d)).alias(f"e{i}")]
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("dated"), F.col(f"f{i}").alias("future"), F.col(f"l{i}").alias("latest"), F.col(f"o{i}").alias("old"), F.col(f"e{i}").alias("earliest")) for i, c in enumerate(columns)]
    return df.agg(*wide).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def span(layers: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(first, last): over all date columns of all layers."""
    parts = None
    for df, columns in layers:
        part = df.agg(*[F.min(as_date(df, c)).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(as_date(df, c)).alias(f"b{i}") for i, c in enumerate(columns)])
        both = [F.array_min(F.array(*[f"a{i}" for i in range(len(columns))])).alias("first"), F.array_max(F.array(*[f"b{i}" for i in range(len(columns))])).alias("last")]
        part = part.select(*both)
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.min("first").alias("first"), F.max("last").alias("last"))
