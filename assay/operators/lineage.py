"""Coordinate systems and edit tracking of a dataset's layers (a row for each layer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the fields that show who edited a row and when.
EDIT_FIELDS = ("created_user", "created_date", "last_edited_user", "last_edited_date", "creator", "creationdate", "editor", "editdate", "updatedby", "lastupdate")


def mode(df: DataFrame, label: str, position: str) -> DataFrame:
    """(label, n): the most frequent label that is not null; ties go to the one that comes first."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return n.orderBy(F.desc("n"), "p").limit(1).select(label, "n")


def crs_deductions(layers: DataFrame) -> DataFrame:
    """(undefined, horizontals, verticals, flat_z, geographic_main, score) of layers (layer, horizontal, vertical, has_z, geographic, pos)."""
    main = mode(layers, "horizontal", "pos").select(F.col("horizontal").alias("main"))
    label = F.coalesce("vertical", F.lit("(none)"))
    main_geo = layers.join(F.broadcast(main), F.col("horizontal") == F.col("main")).agg(F.coalesce(F.bool_or("geographic"), F.lit(False)).alias("geographic_main"))
    seen = layers.agg(
        F.count_if(F.col("horizontal").isNull()).alias("undefined"), F.count_distinct("horizontal").alias("horizontals"), F.count_distinct(label).alias("verticals"),
        (F.coalesce(F.bool_or("has_z"), F.lit(False)) & F.coalesce(F.bool_and(label == "(none)"), F.lit(True))).alias("flat_z"),
    )
    less = F.when(F.col("undefined") > 0, 40).otherwise(0) + F.when(F.col("horizontals") > 1, 40).otherwise(0) + F.when(F.col("verticals") > 1, 15).otherwise(0) + F.when(F.col("flat_z"), 10).otherwise(0) + F.when(F.col("geographic_main"), 10).otherwise(0)
    return seen.crossJoin(F.broadcast(main_geo)).withColumn("score", F.greatest(F.lit(0), 100 - less).cast("double"))  # one row each


def tracking_coverage(fields: DataFrame) -> DataFrame:
    """(layer, tracked) of fields (layer, field): whether the layer has any edit-tracking field."""
    return fields.groupBy("layer").agg(F.bool_or(F.lower("field").isin(*EDIT_FIELDS)).alias("tracked"))


def plausible(west, south, east, north, low_x: float, low_y: float, high_x: float, high_y: float):
    """Whether bounds lie in a coordinate system's area of use, or within its own width and height around it."""
    w, h = high_x - low_x, high_y - low_y
    return (west >= low_x - w) & (east <= high_x + w) & (south >= low_y - h) & (north <= high_y + h)


def plausible_degrees(west, south, east, north):
    return (west >= -540) & (east <= 540) & (south >= -90.5) & (north <= 90.5)
