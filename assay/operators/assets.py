"""Asset types: distinct (group, type) pairs, and their exact and fuzzy counterparts in a baseline.

Data are reduced to distinct pairs first, by map-side counts; only these meet the
baseline, which is broadcast up to a checked number of rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assay.functions.text import name_fold
from assay.operators.domains import small

# The least similarity of a proposal, and that of two group names that may stand for each other.
FUZZY, GROUP = 0.84, 0.8


def pairs(df: DataFrame, layer: str, group: str, kind: str) -> DataFrame:
    """(class_name, asset_group, asset_type, features); null codes are groups of their own."""
    return df.groupBy(F.col(group).cast("string").alias("asset_group"), F.col(kind).cast("string").alias("asset_type")).agg(F.count("*").alias("features")).select(F.lit(layer).alias("class_name"), "asset_group", "asset_type", "features")


def _folded(df: DataFrame, mark: str) -> DataFrame:
    return df.withColumns({f"{mark}c": name_fold(F.col("class_name")), f"{mark}g": name_fold(F.col("asset_group")), f"{mark}t": name_fold(F.col("asset_type"))})


def exact(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """found with ``matched``: class, group and type, folded, are in the baseline, and the type is not empty."""
    base = _folded(baseline, "b").select("bc", "bg", "bt").distinct()
    a = _folded(found, "a")
    hit = a.join(small(base), (F.col("ac") == F.col("bc")) & (F.col("ag") == F.col("bg")) & (F.col("at") == F.col("bt")) & (F.col("at") != ""), "left")
    return hit.select(*found.columns, F.col("bc").isNotNull().alias("matched"))


def _score(g: str, t: str, bg: str, bt: str) -> float:
    by_group = SequenceMatcher(None, g, bg).ratio() if g and bg else None
    if by_group is not None and g != bg and by_group < GROUP:
        return 0.0
    by_type = SequenceMatcher(None, t, bt).ratio() if t and bt else 0.0
    if by_group is None:
        return by_type
    return (by_type + by_group) / 2 if t else by_group


@F.pandas_udf(DoubleType())
def _similarity(g: pd.Series, t: pd.Series, bg: pd.Series, bt: pd.Series) -> pd.Series:
    return pd.Series([_score(*x) for x in zip(g, t, bg, bt, strict=True)], dtype="float64")


def letters(name) -> Column:
    """The letters of a text, each with the number of its turn, as a set; high turns, which are rare, first, then in an order of hashes."""
    each = F.filter(F.split(name, ""), lambda c: c != "")
    turns = F.transform(each, lambda c, i: F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c)))
    keyed = F.zip_with(each, turns, lambda c, k: F.struct((-k).alias("rank"), F.xxhash64(c).alias("hash"), F.concat(k.cast("string"), c).alias("letter")))
    return F.transform(F.array_sort(keyed), lambda x: x.letter)


def _may_reach(x: Column, y: Column, least: Column) -> Column:
    """Whether texts with these letters can have a similarity of ``least``: twice the common letters by the sum of the lengths bounds it."""
    return 2 * F.size(F.array_intersect(x, y)) >= least * (F.size(x) + F.size(y)) - 1e-9


def _meet(x: DataFrame, y: DataFrame, names: list[str]) -> DataFrame:
    """Inner join by scope (null equals null), kind of name and the names; columns of x, then of y."""
    keys = ["scope", "by_type", *names]
    z = y.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return x.join(z, same).drop(*[f"_{k}" for k in keys])


def _near(names: DataFrame, base: DataFrame, least: Column) -> DataFrame:
    """(scope, by_type, name, near): pairs of names whose common letters allow a similarity of ``least``.

    With o common letters of two names of m and n letters, 2 o >= s (m + n) and n >= o
    give o >= s m / (2 - s): a pair shares one of the first m - o + 1 letters of either.
    """

    def indexed(df: DataFrame) -> DataFrame:
        full = df.withColumns({"letters": letters("name"), "least": least})
        m = F.size("letters")
        start = m - F.ceil(F.col("least") * m / (2 - F.col("least")) - 1e-9).cast("int") + 1
        return full.withColumn("letter", F.explode(F.slice("letters", F.lit(1), start)))

    found = _meet(indexed(names), indexed(base).select("scope", "by_type", F.col("name").alias("near"), F.col("letters").alias("others"), "letter"), ["letter"])
    return found.where(_may_reach(F.col("letters"), F.col("others"), F.col("least"))).select("scope", "by_type", "name", "near").distinct()


def fuzzy(found: DataFrame, baseline: DataFrame, least: float = FUZZY) -> DataFrame:
    """(found's columns, match_group, match_type, confidence): the baseline's most similar pair, ``least`` (over a half) at least.

    Candidates are of the same class, or of any class where the baseline lacks it.
    They come from an inverted index of letters (``letters``): a similarity of s
    takes at least s / 2 of both lengths in common letters, so of each name the
    letters but those that would be too few alone meet in the index, and pairs with
    fewer common letters than that are dropped before they are compared.  All joins
    have keys; each distinct pair of folded names is compared once, whatever the
    rows.  Ties go to the first name.  Empty names match nothing.
    """
    base = _folded(baseline, "b").select("bc", "bg", "bt", F.col("asset_group").alias("match_group"), F.col("asset_type").alias("match_type")).distinct()
    a = _folded(found, "a").where("ag <> '' or at <> ''")
    keys = a.select("ac", "ag", "at").distinct().join(small(base.select(F.col("bc").alias("ac"), F.lit(True).alias("known")).distinct()), "ac", "left")
    # by type where there is one, else by group; within a class, or (null) within all
    by_type = F.col("at") != ""
    keys = keys.select("ac", "ag", "at", F.when(F.col("known"), F.col("ac")).alias("scope"), by_type.alias("by_type"), F.when(by_type, F.col("at")).otherwise(F.col("ag")).alias("name"))
    lone = base.select("*", F.explode(F.array("bc", F.lit(None))).alias("scope"))
    lone = lone.select("*", F.explode(F.array(F.struct(F.lit(True).alias("by_type"), F.col("bt").alias("near")), F.struct(F.lit(False).alias("by_type"), F.col("bg").alias("near")))).alias("n")).select("bc", "bg", "bt", "match_group", "match_type", "scope", "n.*").where("near <> ''")
    near = _near(keys.select("scope", "by_type", "name").distinct(), lone.select("scope", "by_type", F.col("near").alias("name")).distinct(), F.when(F.col("by_type"), 2 * least - 1).otherwise(least))
    meet = _meet(_meet(keys, near, ["name"]), lone, ["near"])
    groups = (F.col("ag") == "") | (F.col("bg") == "") | (F.col("ag") == F.col("bg")) | _may_reach(letters("ag"), letters("bg"), F.lit(GROUP))
    names = ["ag", "at", "bg", "bt"]
    judged = meet.where(groups).select(*names).distinct().withColumn("confidence", _similarity(*names)).where(F.col("confidence") >= least)
    scored = meet.join(judged, names)
    best = scored.groupBy("ac", "ag", "at").agg(F.min_by(F.struct("match_group", "match_type", "confidence"), F.struct(-F.col("confidence"), "bg", "bt", "match_group", "match_type")).alias("m"))
    return a.join(best, ["ac", "ag", "at"]).select(*found.columns, "m.match_group", "m.match_type", F.round("m.confidence", 3).alias("confidence"))


def missing_groups(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(class_name, asset_group) of the baseline that the data lack, for classes that the data have; ``unknown`` and empty are ignored."""
    a = _folded(found, "a")
    base = _folded(baseline, "b").where("bg not in ('', 'unknown')").select("class_name", "asset_group", "bc", "bg").distinct()
    base = base.join(a.select(F.col("ac").alias("bc")).distinct(), "bc", "left_semi")
    return base.join(a.select(F.col("ac").alias("bc"), F.col("ag").alias("bg")).distinct(), ["bc", "bg"], "left_anti").select("class_name", "asset_group")


def unmapped_labels(unmatched: DataFrame, shown: int = 12) -> DataFrame:
    """(class_name, n, labels): how many pairs of each class have no match, and the first labels in name order."""
    label = F.concat_ws(" / ", F.coalesce("asset_group", F.lit("(none)")), F.coalesce("asset_type", F.lit("(none)")))
    rows = unmatched.select("class_name", label.alias("label")).distinct()
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("class_name").orderBy("label")))
    return few.groupBy("class_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.col("label")))), "; ").alias("labels"))


def baseline_rows(classes: DataFrame, codes: DataFrame, prefer: str = "essential") -> DataFrame:
    """A baseline from class definitions of several packages: (domain, class_name, asset_group, asset_group_code, asset_type, asset_type_code, package).

    classes: (domain, package, class_name, subtypes array<struct<code, name, domains array<struct<field, domain>>>>);
    codes: (package, name, code, label).  Of rows alike the package named ``prefer`` wins, then the first name.
    """
    flat = classes.select("domain", "package", "class_name", F.explode("subtypes").alias("s"))
    flat = flat.select("domain", "package", "class_name", F.col("s.name").alias("asset_group"), F.col("s.code").alias("asset_group_code"), F.explode(F.filter("s.domains", lambda d: F.lower(d["field"]) == "assettype")).alias("d"))
    full = flat.join(codes, (flat["package"] == codes["package"]) & (F.col("d.domain") == codes["name"])).select("domain", flat["package"], "class_name", "asset_group", "asset_group_code", F.col("label").alias("asset_type"), F.col("code").alias("asset_type_code"))
    return preferred(full, ["domain", "class_name", "asset_group_code", "asset_type_code"], F.lower("package").contains(prefer), "package")


def preferred(df: DataFrame, keys: list[str], prefer, tie: str) -> DataFrame:
    """One row for each key: a preferred one if there is one, then the smallest ``tie``; by a map-side minimum, not by a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((~F.coalesce(prefer, F.lit(False))).alias("p"), F.col(tie).alias("t"))).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*df.columns)
