"""Conformance to a reference model: fields, classes, counterparts, and the model that fits a dataset best.

Schemas are tables (class, kind, field, type, domain, nullable, required) with a row
for each field: sizes of schemas, not of data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import domain_guess, type_family
from assay.operators.completeness import TRACKING, TRACKING_GROUPS

# Fixed value: types that have nothing to compare.
SKIPPED = r"(?i)OID|Geometry|Blob|Raster|XML"
_GROUP = {n: i for i, g in enumerate(TRACKING_GROUPS) for n in g}


def _group(name):
    return F.create_map(*[x for n, i in _GROUP.items() for x in (F.lit(n), F.lit(i))])[name]


def field_conformance(source: DataFrame, model: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, field, status): ok, type, domain, missing, missing required or extra, for the class pairs (class, counterpart).

    A missing field is forgiven where the source tracks the same thing under another
    name; an extra tracking field is, where the model tracks anything at all.
    """
    cols = [F.lower("field").alias("field"), F.col("type"), F.col("domain"), F.coalesce("nullable", F.lit(True)).alias("nullable"), F.coalesce("required", F.lit(False)).alias("required")]
    have = source.where(~F.coalesce(F.col("type").rlike(SKIPPED), F.lit(False))).join(pairs.select("class"), "class", "left_semi").select("class", *cols)
    want = model.where(~F.coalesce(F.col("type").rlike(SKIPPED), F.lit(False))).select(F.col("class").alias("counterpart"), *cols).join(pairs, "counterpart").drop("counterpart")
    tracked = have.select("class", _group(F.col("field")).alias("g")).where("g is not null").distinct().withColumn("covered", F.lit(True))
    tracks = want.where(F.col("field").isin(*TRACKING)).select("class").distinct().withColumn("tracks", F.lit(True))
    a, b = have.alias("a"), want.alias("b")
    both = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.field") == F.col("b.field")), "full_outer").select(
        F.coalesce("a.class", "b.class").alias("class"), F.coalesce("a.field", "b.field").alias("field"), F.col("a.field").isNotNull().alias("here"), F.col("b.field").isNotNull().alias("there"),
        type_family(F.col("a.type")).alias("fa"), type_family(F.col("b.type")).alias("fb"), F.col("a.domain").alias("da"), F.col("b.domain").alias("db"), F.col("b.nullable").alias("nullable"), F.col("b.required").alias("required"),
    )
    both = both.withColumn("g", _group(F.col("field"))).join(tracked, ["class", "g"], "left").join(tracks, "class", "left")
    tracking = F.col("g").isNotNull()
    needed = (~F.col("nullable") | F.col("required") | F.col("field").isin("assetgroup", "assettype")) & ~tracking
    status = (
        F.when(~F.col("here"), F.when(tracking & F.col("covered").isNotNull(), "ok").when(needed, "missing required").otherwise("missing"))
        .when(~F.col("there"), F.when(tracking & F.col("tracks").isNotNull(), "ok").otherwise("extra"))
        .when(F.col("fa") != F.col("fb"), "type")
        .when(F.col("db").isNotNull() & (F.lower(F.coalesce("da", F.lit(""))) != F.lower("db")), "domain")
        .otherwise("ok")
    )
    return both.select("class", "field", status.alias("status"), "there")


def conformance_scores(fields: DataFrame) -> DataFrame:
    """(class, fields, missing, mismatched, score): 100 * (fields - missing - mismatched) / fields of the model's fields."""
    n = fields.groupBy("class").agg(
        F.count_if("there").alias("fields"), F.count_if(F.col("status").startswith("missing")).alias("missing"), F.count_if(F.col("status") == "type").alias("mismatched"),
    )
    return n.withColumn("score", F.coalesce(F.try_divide(100.0 * (F.col("fields") - F.col("missing") - F.col("mismatched")), F.col("fields")), F.lit(100.0)))


def counterparts(source: DataFrame, model: DataFrame, least: float = 0.5) -> DataFrame:
    """(class, counterpart, similarity): the model class of the same name, else of the same kind with the largest field Jaccard, ``least`` at least.

    Ties go to the first name.  Candidates are found by shared fields, so classes with nothing in common never meet.
    """
    a = source.groupBy("class").agg(F.first("kind").alias("kind"), F.collect_set(F.lower("field")).alias("fa"))
    b = model.groupBy(F.col("class").alias("counterpart")).agg(F.first("kind").alias("kind_b"), F.collect_set(F.lower("field")).alias("fb"))
    same = a.join(b, F.lower("class") == F.lower("counterpart")).select("class", "counterpart", F.lit(1.0).alias("similarity"), F.lit(0).alias("turn"))
    shared = source.select("class", F.lower("field").alias("f")).distinct().join(model.select(F.col("class").alias("counterpart"), F.lower("field").alias("f")).distinct(), "f").groupBy("class", "counterpart").agg(F.count("*").alias("k"))
    jaccard = shared.join(a, "class").join(b, "counterpart").where("kind = kind_b").select("class", "counterpart", (F.col("k") / (F.size("fa") + F.size("fb") - F.col("k"))).alias("similarity"), F.lit(1).alias("turn")).where(F.col("similarity") >= least)
    best = Window.partitionBy("class").orderBy("turn", F.desc("similarity"), "counterpart")
    return same.unionByName(jaccard).withColumn("r", F.row_number().over(best)).where("r = 1").select("class", "counterpart", "similarity")


def match_models(source: DataFrame, models: DataFrame, name: str, path: str = "", keep: int = 5, flavours: tuple[str, ...] = ("essential", "balanced", "advanced")) -> DataFrame:
    """(model, score, rank): 3 * class Jaccard + field Jaccard + bonuses of models (model, class, field), the best ``keep``.

    0.5 for the same guessed domain, 0.15 for the first flavour word that is in both names.
    """
    hint = f"{path} {name}".lower()
    classes, fields = source.select(F.lower("class").alias("c")).distinct(), source.select(F.lower("field").alias("f")).distinct()

    def jaccard(mine: DataFrame, col: str, key: str) -> DataFrame:
        theirs = models.select("model", F.lower(col).alias(key)).distinct()
        sizes = theirs.groupBy("model").agg(F.count("*").alias("m"))
        shared = theirs.join(mine, key).groupBy("model").agg(F.count("*").alias("k"))
        n = mine.agg(F.count("*").alias("n"))
        return sizes.join(shared, "model", "left").crossJoin(F.broadcast(n)).select("model", (F.coalesce("k", F.lit(0)) / (F.col("m") + F.col("n") - F.coalesce("k", F.lit(0)))).alias(f"j_{key}"))

    flavour = next((w for w in flavours if w in hint), None)
    low = F.lower("model")
    bonus = F.when(domain_guess(F.col("model")) == domain_guess(F.lit(hint)), 0.5).otherwise(0.0)
    if flavour:
        bonus = bonus + F.when(low.contains(flavour), 0.15).otherwise(0.0)
    both = jaccard(classes, "class", "c").join(jaccard(fields, "field", "f"), "model").where(low != name.lower())
    scored = both.select("model", F.round(3 * F.col("j_c") + F.col("j_f") + bonus, 3).alias("score"))
    top = scored.orderBy(F.desc("score"), "model").limit(keep)  # a handful: ranked in one array
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "model", "score"))).alias("t")).select(F.posexplode("t").alias("pos", "t"))
    return ranked.select("t.model", "t.score", (F.col("pos") + 1).alias("rank"))
