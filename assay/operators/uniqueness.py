"""Duplicates inside and across layers, and the first ids of a finding.

Groups are counted with map-side partial sums; members come back by a semi join on
the few repeated keys, which Spark may split when one key is hot, so no task ever
holds all rows of a key (a window over the key would).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import guid


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, members) of the keys that occur more than once; rows with a null key take no part."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every member row of a repeated key."""
    return df.join(repeated(df, keys).select(*keys), list(keys), "left_semi").select(*df.columns)


def repeated_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: groups, members."""
    return repeated(df, keys).agg(F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).cast("long").alias("members"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n) of the k most frequent repeated values; ties go to the smaller value."""
    return repeated(df.select(F.col(column).alias("value")), ["value"]).select("value", F.col("members").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def stack_ids(layers: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(layer, gid): the normalised, non-empty ids of several layers."""
    parts = [df.select(F.lit(name).alias("layer"), guid(F.col(f"`{col}`").cast("string")).alias("gid")) for name, (df, col) in layers.items()]
    return reduce(DataFrame.unionByName, parts).where("gid is not null and gid <> ''")


def id_usage(layers: Mapping[str, tuple[DataFrame, Sequence[tuple[str, Column]]]]) -> DataFrame:
    """(layer, field, filled, members, shared) of id fields, layer -> (rows, [(field, id)]).

    filled: rows with an id, neither null nor empty; members: rows whose id repeats in the layer; shared: rows whose id
    another layer has in the same field.  Each layer is scanned once for all its fields; counts of (field, id, layer) are
    summed in the tasks before they are shuffled.
    """
    one = lambda f, key: F.struct(F.lit(f).alias("field"), key.cast("string").alias("key"))
    parts = [df.select(F.lit(n).alias("layer"), F.explode(F.array(*[one(f, key) for f, key in fields])).alias("k")).select("layer", "k.*") for n, (df, fields) in layers.items()]
    per = reduce(DataFrame.unionByName, parts).where("key is not null and key <> ''").groupBy("field", "key", "layer").agg(F.count("*").alias("n"))
    whole = per.groupBy("field", "key").agg(F.collect_list(F.struct("layer", "n")).alias("each"))  # as many as layers at most
    back = whole.select("field", F.size("each").alias("in_layers"), F.explode("each").alias("e"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return back.groupBy(F.col("e.layer").alias("layer"), "field").agg(total(F.col("e.n"), "filled"), total(F.when(F.col("e.n") > 1, F.col("e.n")), "members"), total(F.when(F.col("in_layers") > 1, F.col("e.n")), "shared"))


def across_layers(ids: DataFrame) -> DataFrame:
    """(gid, rows, layers) of ids used in more than one layer; layers is a sorted, comma-separated list."""
    per = ids.groupBy("gid", "layer").agg(F.count("*").alias("n"))
    return per.groupBy("gid").agg(F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.count("*").alias("k")).where("k > 1").select("gid", "rows", "layers")


def first_ids(df: DataFrame, by: Sequence[str], id_col: str, n: int = 25) -> DataFrame:
    """(by, ids): the first n distinct ids of each group in id order, comma-separated.

    Ranking is pruned to n rows a group in each task before it is shuffled.
    """
    rank = Window.partitionBy(*by).orderBy(id_col)
    few = df.select(*by, id_col).withColumn("__r", F.dense_rank().over(rank)).where(F.col("__r") <= n)
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(id_col)), lambda x: x.cast("string")), ",").alias("ids"))
