"""Field profiles: null rates, capped distinct counts, key candidates, weak fields.

One scan gives blanks and estimates of the distinct values.  Only columns whose
estimate is near or below the cap are counted exactly, in one more scan whose
state is bounded by the cap; the others are reported as more than the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import as_text, blank, is_null, ws_trim

CAP, WEAK = 5000, 0.2


def _value(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if kind.typeName() in ("array", "map", "struct"):
        return F.to_json(c)
    return F.when(~is_null(c, kind), ws_trim(as_text(c, kind)))


def field_profile(df: DataFrame, layer: str, cap: int = CAP) -> DataFrame:
    """(layer, field, type, rows, nulls, null_rate, distinct, key_candidate); distinct is a text, ``>5000`` beyond the cap."""
    flat = {f.name: f.dataType for f in df.schema}
    tests = {n: F.col(f"`{n}`").isNull() if k.typeName() in ("array", "map", "struct") else blank(F.col(f"`{n}`"), k) for n, k in flat.items()}
    first = df.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(f"b{i}") for i, t in enumerate(tests.values())], *[F.approx_count_distinct(_value(df, n), 0.02).alias(f"d{i}") for i, n in enumerate(flat)]).head()
    near = {n: i for i, n in enumerate(flat) if first[f"d{i}"] <= 1.1 * cap}
    exact = df.agg(*[F.size(F.collect_set(_value(df, n))).alias(f"x{i}") for n, i in near.items()]).head() if near else None
    rows = []
    for i, (n, k) in enumerate(flat.items()):
        d = exact[f"x{i}"] if n in near else cap + 1
        nulls, total = first[f"b{i}"], first["rows"]
        key = bool(total) and not nulls and d <= cap and d == total and "geom" not in n.lower()
        rows.append((layer, n, k.simpleString(), total, nulls, round(nulls / total, 4) if total else 0.0, str(d) if d <= cap else f">{cap}", key))
    return df.sparkSession.createDataFrame(rows, "layer string, field string, type string, rows long, nulls long, null_rate double, distinct string, key_candidate boolean")


def layer_profile(fields: DataFrame, weak: float = WEAK) -> DataFrame:
    """(layer, rows, fields, key_candidates, weak_fields) from field profiles; lists are sorted and comma-separated."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("field")))), ",")
    return fields.groupBy("layer").agg(F.max("rows").alias("rows"), F.count("*").alias("fields"), pick(F.col("key_candidate")).alias("key_candidates"), pick((F.col("null_rate") >= weak) & (F.col("rows") > 0)).alias("weak_fields"))
