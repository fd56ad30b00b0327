"""Field mapping tables against the data and the model: coverage, unknown names, expected row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import ws_trim
from assay.operators.completeness import TRACKING
from assay.operators.domains import small

# Fields that systems fill and no mapping has to name.
SYSTEM_FIELDS = ("objectid", "shape", "shape_length", "shape_area", "shape.len", "shape.area", "globalid", "fid", "st_length(shape)", "st_area(shape)", "shape_leng")


def aliases(match: DataFrame) -> DataFrame:
    """(source, target) field aliases of a match table (type, SubstringsA, SubstringsB, match_strings), lower case."""
    exact = (ws_trim(F.lower("type")) == "field") & (ws_trim(F.lower("match_strings")) == "exact_match")
    return match.where(exact).select(ws_trim(F.lower("SubstringsA")).alias("source"), ws_trim(F.lower("SubstringsB")).alias("target")).where("source <> '' and target <> ''").distinct()


def stray_space(match: DataFrame) -> DataFrame:
    """Rows of a match table with white space around a cell."""
    test = F.lit(False)
    for c in match.columns:
        test = test | F.coalesce(F.col(c) != ws_trim(F.col(c)), F.lit(False))
    return match.where(test)


def _wanted(name: Column) -> Column:
    return ~name.isin(*SYSTEM_FIELDS) & ~name.isin(*TRACKING)


def coverage(fields: DataFrame, targets: DataFrame, alias: DataFrame, class_map: DataFrame) -> DataFrame:
    """(layer, fields, mapped, coverage): how many fields of fields (layer, field) the model can take.

    targets (class, field); class_map (layer, class).  A layer without mapped classes
    may use the fields of all of them.  A name is taken if it, or any alias of it, is
    a target, or if it ends in ``_globalid``.
    """
    wanted = fields.select("layer", F.lower("field").alias("field")).where(_wanted(F.col("field"))).distinct()
    names = targets.select("class", F.lower("field").alias("target"))
    own = class_map.join(names, "class").select("layer", "target").distinct()
    rest = wanted.select("layer").distinct().join(class_map.select("layer"), "layer", "left_anti")
    # every name for each unmapped layer: sizes of schemas
    open_ = rest.join(small(names.select("target").distinct()), F.lit(True))
    allowed = own.unionByName(open_)
    tried = wanted.select("layer", "field", F.col("field").alias("target")).unionByName(wanted.join(alias, F.col("field") == F.col("source")).select("layer", "field", "target"))
    hit = tried.join(allowed, ["layer", "target"], "left_semi").select("layer", "field").distinct().withColumn("hit", F.lit(True))
    state = wanted.join(hit, ["layer", "field"], "left").withColumn("mapped", F.col("hit").isNotNull() | (F.col("field").endswith("_globalid") & (F.col("field") != "globalid")))
    return state.groupBy("layer").agg(F.count("*").alias("fields"), F.count_if("mapped").alias("mapped")).withColumn("coverage", F.round(100.0 * F.col("mapped") / F.col("fields"), 1))


def unknown_names(alias: DataFrame, fields: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, name): source fields that no layer has, target fields that no class has."""
    a = alias.select(F.lit("source").alias("side"), F.col("source").alias("name")).join(fields.select(F.lower("field").alias("name")), "name", "left_anti")
    b = alias.select(F.lit("target").alias("side"), F.col("target").alias("name")).join(targets.select(F.lower("field").alias("name")), "name", "left_anti")
    return a.unionByName(b).select("side", "name").distinct()


def row_counts(book: DataFrame, actual: DataFrame) -> DataFrame:
    """(class, expected, actual, status) of a mapping workbook (source_class, target_class, rows) against counts (layer, rows)."""
    want = book.groupBy(F.lower("source_class").alias("class")).agg(F.sum("rows").cast("long").alias("expected"))
    have = actual.select(F.lower("layer").alias("class"), F.col("rows").alias("actual"))
    return want.join(have, "class", "left").withColumn("status", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "differs").otherwise("ok"))
