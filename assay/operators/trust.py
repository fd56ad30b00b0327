"""Findings and what is built on them: ids, classes, order, questions, dispositions, signatures, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import rule_key

STAGES = ("discover", "metadata", "lineage", "schema", "quality", "report")
SEVERITIES = ("critical", "error", "warning", "info")

# A finding's class by stage, what to do by class, whom to ask and how urgently.
CLASSES = {"quality": "defect", "schema": "conformance", "metadata": "completeness", "lineage": "lineage", "discover": "discovery", "report": "observation"}
ACTIONS = {
    "defect": "Correct the affected records, or mark the finding accepted if it is a known exception.",
    "conformance": "Align the class with the reference model, or document why the local difference is intentional.",
    "completeness": "Add the missing metadata so a later reader can tell what the data is and how it may be used.",
    "lineage": "Record where the data came from, which coordinate system it uses, and who last edited it.",
    "discovery": "Confirm the dataset is complete and that anything missing is expected.",
    "observation": "Review the note and close it if no change is required.",
}
ROLES = {"metadata": "Data steward", "lineage": "GIS administrator", "schema": "Data modeler", "quality": "Data editor", "discover": "GIS administrator", "report": "Data steward"}
WHY = {
    "discover": "What is missing from the inventory is never checked.", "metadata": "Readers without metadata cannot tell what the data are and how they may be used.",
    "lineage": "Without a known source and coordinate system the data cannot be combined with others.", "schema": "Data that differ from the model are refused or changed when they are loaded.",
    "quality": "Defective records spread into every product made from them.", "report": "The note may explain other findings.",
}
PRIORITIES = {"critical": "urgent", "error": "high", "warning": "medium", "info": "low"}
#: Part of every finding id.
ID_TAG = "assay-finding-1"

#: dataset, stage, check, severity, layer, message, count, ids (text), detail
BASE = "dataset string, stage string, check string, severity string, layer string, message string, count long, ids string, detail string"
#: What a check may say beside that.
MORE = "rule string, confidence double, evidence string, method string, threshold string, affected_count long, action string"


def _pick(table: dict[str, str], key: Column, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in reversed(table.items()):
        out = F.when(key == k, v).otherwise(out)
    return out


def classification(stage: Column, severity: Column) -> Column:
    return F.when((severity == "info") & (stage != "discover"), "observation").otherwise(_pick(CLASSES, stage, "observation"))


def action(kind: Column) -> Column:
    return _pick(ACTIONS, kind, ACTIONS["observation"])


def finding_id(check: Column, layer: Column, rule: Column, keys: Column) -> Column:
    """20 hex digits of the SHA-256 of the tag, check, layer, rule and the sorted distinct record keys, a line each."""
    head = F.array(F.lit(ID_TAG), *[F.coalesce(c, F.lit("")) for c in (check, layer, rule)])
    return F.substring(F.sha2(F.array_join(F.concat(head, F.array_sort(F.array_distinct(keys))), "\n"), 256), 1, 20)


def complete(findings: DataFrame) -> DataFrame:
    """findings (BASE) with rule, classification, action and finding_id."""
    keys = F.when(F.coalesce("ids", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    out = findings.withColumn("rule", rule_key(F.col("message"))).withColumn("classification", classification(F.col("stage"), F.col("severity")))
    return out.withColumn("action", action(F.col("classification"))).withColumn("finding_id", finding_id(F.col("check"), F.col("layer"), F.col("rule"), keys))


def detailed(findings: DataFrame) -> DataFrame:
    """findings (BASE and MORE) with finding_id and, where a check did not say more, the defaults of each column."""
    keys = F.when(F.coalesce("ids", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    kind = classification(F.col("stage"), F.col("severity"))
    said = lambda c, otherwise: F.coalesce(F.when(F.col(c) != "", F.col(c)), otherwise)
    out = findings.withColumns({"rule": said("rule", rule_key(F.col("message"))), "classification": kind})
    return out.withColumns({
        "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))), 4), "evidence": said("evidence", said("detail", F.col("message"))),
        "method": said("method", F.col("check")), "threshold": F.coalesce("threshold", F.lit("")), "action": said("action", action(F.col("classification"))),
        "affected_count": F.coalesce("affected_count", "count", F.size(keys).cast("long")), "finding_id": finding_id(F.col("check"), F.col("layer"), F.col("rule"), keys),
    })


#: The columns of the findings report, in order.
REPORT = {
    "dataset": "dataset", "severity": "severity", "stage": "stage", "check": "check", "layer": "layer", "count": "count", "message": "message", "detail": "detail", "sample_object_ids": "ids", "finding_id": "finding_id",
    "rule": "rule", "classification": "classification", "confidence": "confidence", "evidence": "evidence", "method": "method", "threshold": "threshold", "affected_count": "affected_count",
    "affected_record_ids": "ids", "recommended_action": "action", "disposition": "disposition", "disposition_note": "disposition_note",
}


def report(findings: DataFrame) -> DataFrame:
    """The findings report: detailed findings, disposed of or not, in its 21 columns; ids with a blank between."""
    have = findings if "disposition" in findings.columns else findings.withColumns({"disposition": F.lit("OPEN"), "disposition_note": F.lit("")})
    return have.select(*[(F.translate(F.col(c), ",", " ") if c == "ids" else F.col(c)).alias(n) for n, c in REPORT.items()])


def rank_of(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1, F.lit(9)).cast("int")


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then most records, then check, layer and id."""
    return findings.withColumn("rank", rank_of(F.col("severity"))).orderBy("rank", F.desc(F.coalesce("count", F.lit(0))), "check", "layer", "finding_id")


def search(findings: DataFrame, severities: list[str] | None = None, stage: str | None = None, layer: str | None = None, text: str = "") -> DataFrame:
    """Findings of these severities, stage and layer whose message, detail, layer or check holds the text in any case."""
    out = findings
    if severities is not None:
        out = out.where(F.col("severity").isin(*severities))
    if stage is not None:
        out = out.where(F.col("stage") == stage)
    if layer is not None:
        out = out.where(F.col("layer") == layer)
    return out.where(F.lower(F.concat_ws(" ", "message", "detail", "layer", "check")).contains(text.lower()))


def dispose(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """findings with ``disposition`` (OPEN without an entry) and ``disposition_note`` from (finding_id, status, note)."""
    d = dispositions.select("finding_id", F.upper("status").alias("__s"), F.col("note").alias("disposition_note"))
    return findings.join(d, "finding_id", "left").withColumn("disposition", F.coalesce("__s", F.lit("OPEN"))).drop("__s")


def questions(findings: DataFrame, limit: int = 200) -> DataFrame:
    """One question for each dataset, stage, check, layer and severity of the open findings, urgent ones first."""
    still = findings.where(F.upper(F.coalesce("disposition", F.lit("OPEN"))) == "OPEN")
    keys = ["dataset", "stage", "check", "layer", "severity"]
    rows = still.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("finding_id")), ",").alias("finding_ids"))
    # Fixed value: the sentence that is asked
    asked = F.concat(F.lit("Is the '"), F.coalesce("check", F.lit("this check")), F.lit("' result on "), F.when(F.coalesce("layer", F.lit("")) == "", "the dataset").otherwise(F.col("layer")), F.lit(" expected, and if not, who will correct it?"))
    rows = rows.withColumns({"question": asked, "role": _pick(ROLES, F.col("stage"), "Data steward"), "priority": _pick(PRIORITIES, F.col("severity"), "low"), "why_it_matters": _pick(WHY, F.col("stage"), WHY["report"])})
    return rows.withColumn("rank", rank_of(F.col("severity"))).orderBy("rank", "dataset", "check", "layer", "stage").limit(limit)


def severity_counts(findings: DataFrame, by: str = "dataset") -> DataFrame:
    return findings.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def signature(findings: DataFrame, columns: tuple[str, ...] = ("finding_id", "check", "layer", "severity", "message", "count", "stage", "rule", "classification")) -> DataFrame:
    """(signature, rows): one hash over all findings in any order: each row's hash, sorted, hashed again."""
    row = F.sha2(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), "\n"), 256)
    hashes = findings.select(row.alias("h"))
    # findings are few (schema-sized): their sorted hashes fit one cell
    return hashes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("signature"), F.count("*").alias("rows"))


def run_diff(previous: DataFrame, current: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, field, before, after) of all values that differ between two runs; a row that one run lacks differs in ``present``."""
    a = previous.select(F.col(key).alias("k"), F.lit("yes").alias("present"), *[F.col(v).cast("string").alias(v) for v in values])
    b = current.select(F.col(key).alias("k"), F.lit("yes").alias("present"), *[F.col(v).cast("string").alias(v) for v in values])
    fields = ["present", *values]
    both = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"), "full_outer")
    rows = both.select(F.coalesce("a.k", "b.k").alias(key), F.col("a.k").isNotNull().alias("ina"), F.col("b.k").isNotNull().alias("inb"), F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"a.{v}").alias("before"), F.col(f"b.{v}").alias("after")) for v in fields])).alias("r"))
    lone = F.col("r.field") == "present"
    return rows.where(F.when(F.col("ina") & F.col("inb"), ~F.col("r.before").eqNullSafe(F.col("r.after"))).otherwise(lone)).select(key, "r.field", "r.before", "r.after")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hash_sample(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """n rows of each group, the same ones whatever the partitioning: those whose id hashes lowest (pruned to n in each task first)."""
    from pyspark.sql import Window

    h = F.md5(F.col(id_col).cast("string"))
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(h, id_col))).where(F.col("__r") <= n).drop("__r")


def extent(df: DataFrame, x: str, y: str, low: float = 0.08, high: float = 0.92) -> DataFrame:
    """(west, south, east, north): between nearest-rank percentiles, without sorting in one task."""
    p = lambda c, q: F.expr(f"percentile_disc({q}) within group (order by {c})")
    return df.agg(p(x, low).alias("west"), p(y, low).alias("south"), p(x, high).alias("east"), p(y, high).alias("north"))
