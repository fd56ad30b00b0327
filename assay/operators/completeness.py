"""Required values: which fields are required, how many rows leave them blank, which rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import blank

# Fields required wherever they exist, and names that editing tools maintain (any one of a group covers it).
REQUIRED = ("GLOBALID", "ASSETGROUP", "ASSETTYPE")
TRACKING_GROUPS = (
    ("created_user", "creator", "createdby", "created_by", "creationuser"),
    ("created_date", "creationdate", "createdate", "created_on", "datecreated"),
    ("last_edited_user", "updatedby", "editor", "lastuser", "last_edited_by", "lasteditor"),
    ("last_edited_date", "lastupdate", "editdate", "last_edited_on", "datemodified"),
)
TRACKING = tuple(n for g in TRACKING_GROUPS for n in g)


def required_fields(fields: DataFrame, always: Iterable[str] = REQUIRED) -> DataFrame:
    """Of fields (layer, name, type, nullable, required): those that must be filled, with ``configured``.

    A field is required by configuration, or by being not nullable or marked; ids,
    geometry, tracked and shape fields are left to those who maintain them.
    """
    low = F.lower("name")
    configured = low.isin(*[a.lower() for a in always])
    own = F.col("type").rlike("(?i)OID|Geometry") | low.isin(*TRACKING) | low.startswith("shape")
    needed = configured | ((~F.coalesce("nullable", F.lit(True)) | F.coalesce("required", F.lit(False))) & ~F.coalesce(own, F.lit(False)))
    return fields.where(needed).select("layer", "name", configured.alias("configured"), F.coalesce("nullable", F.lit(True)).alias("nullable")).distinct()


def blanks(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    return {c: blank(F.col(f"`{c}`"), kinds[c.lower()]) for c in columns}


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, rows, empty) of each column: one scan, one partial aggregate."""
    tests = blanks(df, columns)
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())])
    return wide.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("empty")) for i, c in enumerate(tests)])).alias("f")).select("f.field", "rows", "f.empty")


def blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that leave any of the columns blank."""
    test = F.lit(False)
    for t in blanks(df, columns).values():
        test = test | t
    return df.where(test)


def severity_of(field: Column, configured: Column, nullable: Column) -> Column:
    """critical for the global id, error for configured and not nullable fields, else warning."""
    return F.when(F.upper(field) == "GLOBALID", "critical").when(configured | ~nullable, "error").otherwise("warning")
