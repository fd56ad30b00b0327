"""Domains: coded values, ranges, subtypes, and the integrity of the references to them.

Domain tables are schema-sized (a row for each code): they are broadcast behind a
check of their row count, and joined by shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import number, type_family, ws_trim

#: Rows up to which a table of codes is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def code_keys(codes: DataFrame) -> DataFrame:
    """(domain, key): what values are compared with.  If any code of a domain is a number, only its numbers count."""
    num = number(F.col("code"))
    kinds = codes.groupBy("domain").agg(F.max(num.isNotNull()).alias("numeric"))
    keyed = codes.join(kinds, "domain")
    return keyed.select("domain", "numeric", F.when(F.col("numeric"), num.cast("string")).otherwise(ws_trim(F.col("code"))).alias("key")).where("key is not null").distinct()


def assigned(df: DataFrame, id_col: str, value_col: str, domain: Column) -> DataFrame:
    """(id, value, domain) of the rows that have a value and a domain."""
    return df.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("value"), domain.alias("domain")).where("value is not null and domain is not null")


def coded_violations(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Of values (id, value, domain) those that are no code of their domain.

    A numeric domain rejects what is not a number; a text domain compares trimmed
    texts and accepts empty ones.  Domains without codes are not checked.
    """
    keys = code_keys(codes)
    kinds = small(keys.select("domain", "numeric").distinct())
    typed = values.join(kinds, "domain")
    key = F.when(F.col("numeric"), number(F.col("value")).cast("string")).otherwise(ws_trim(F.col("value")))
    typed = typed.withColumn("key", key).where(F.col("numeric") | (F.coalesce("key", F.lit("")) != ""))
    return typed.join(small(keys.select("domain", "key")), ["domain", "key"], "left_anti").select("id", "value", "domain")


def breaks_codes(value: Column, keys: Sequence[str], numeric: bool) -> Column:
    """Whether a value (text, not null) is none of a domain's codes, as coded_violations has it; keys and numeric are those of code_keys."""
    if numeric:
        num = number(value)
        return num.isNull() | ~num.isin(*[float(k) for k in keys])
    return (ws_trim(value) != "") & ~ws_trim(value).isin(*keys)


def breaks_range(value: Column, low: float | None, high: float | None) -> Column:
    """Whether a value is a number outside [low, high]; a null bound is open."""
    num = number(value)
    return F.coalesce((num < F.lit(float("-inf") if low is None else float(low))) | (num > F.lit(float("inf") if high is None else float(high))), F.lit(False))


def range_violations(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of values (id, value, domain) the numbers outside [min, max] of ranges (domain, min, max); a null bound is open."""
    num = number(F.col("value"))
    out = (num < F.coalesce(F.col("min"), F.lit(float("-inf")))) | (num > F.coalesce(F.col("max"), F.lit(float("inf"))))
    return values.join(small(ranges), "domain").where(F.coalesce(out, F.lit(False))).select("id", "value", "domain")


def top_violations(bad: DataFrame, k: int = 6) -> DataFrame:
    """(domain, value, n, rank): the k most frequent offending values of each domain, ties by value."""
    n = bad.groupBy("domain", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def missing_domains(references: DataFrame, domains: DataFrame) -> DataFrame:
    """References (layer, field, type, domain) to domains that do not exist."""
    return references.where("domain is not null").join(domains.select(F.col("name").alias("domain")), "domain", "left_anti").select("layer", "field", "domain")


def mismatched_domains(references: DataFrame, domains: DataFrame) -> DataFrame:
    """References whose field is of another family than the domain; whole and floating numbers go together, unknown types with all."""
    known = ("int", "float", "date", "guid", "text")
    pair = references.join(domains.select(F.col("name").alias("domain"), "field_type"), "domain").select("layer", "field", "domain", type_family(F.col("type")).alias("field_family"), type_family(F.col("field_type")).alias("domain_family"))
    numbers = F.col("field_family").isin("int", "float") & F.col("domain_family").isin("int", "float")
    return pair.where((F.col("field_family") != F.col("domain_family")) & ~numbers & F.col("field_family").isin(*known) & F.col("domain_family").isin(*known))


def unused_domains(references: DataFrame, domains: DataFrame) -> DataFrame:
    return domains.select("name").join(references.select(F.col("domain").alias("name")), "name", "left_anti").distinct()
