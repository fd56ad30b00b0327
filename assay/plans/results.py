"""What a run leaves behind: a result document, its signature, a manifest with input hashes, and the replay that verifies it.

Documents hold findings, scores and layer counts: their size grows with schemas,
never with data.  They are JSON without NaN, dates as text, keys sorted.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from assay.operators import trust
from assay.plans.rules import digest
from assay.plans.run import Result, mean_score, validate
from assay.sources import sinks
from assay.sources.dataset import Dataset

VERSION = 1
#: What of a finding the signature covers.
SIGNED = ("finding_id", "severity", "stage", "check", "layer", "rule", "classification", "confidence", "count", "affected_count", "message", "action")


def plain(value: Any) -> Any:
    """value as JSON can hold it: NaN and infinities are null, dates and other things are text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, str | int | bool):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    return str(value)


def dataset_document(result: Result, dispositions: DataFrame | None = None) -> dict[str, Any]:
    found = trust.dispose(result.findings, dispositions) if dispositions is not None else result.findings
    rows = [plain(r.asDict()) for r in trust.ordered(found).drop("rank").collect()]
    counts = {s: sum(r["severity"] == s for r in rows) for s in trust.SEVERITIES}
    return {
        "dataset": result.dataset, "status": result.status, "overall": result.score, "grade": result.grade, "stages": result.stages, "counts": counts,
        "layers": [{"layer": n, "rows": k} for n, k in result.layers], "findings": rows, "tables": sorted(result.tables), "events": plain(result.events),
    }


def document(results: Iterable[Result], dispositions: DataFrame | None = None, generated: datetime | None = None) -> dict[str, Any]:
    """One document of one or several datasets' runs; ``overall`` is the mean of those that did not fail."""
    results = list(results)
    out = {
        "version": VERSION, "generated": plain(generated or datetime.now()), "rules": results[0].rules if results else {}, "rules_sha256": results[0].rules_sha256 if results else "",
        "overall": mean_score(results), "datasets": sorted((dataset_document(r, dispositions) for r in results), key=lambda d: d["dataset"]),
    }
    return out | {"signature": signature(out)}


def canonical(value: Any) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def payload(doc: dict) -> dict:
    """What the signature depends on: no times, no paths, no dispositions."""
    view = lambda f: {k: f.get(k) for k in SIGNED}
    return {"rules_sha256": doc["rules_sha256"], "datasets": [{k: d[k] for k in ("dataset", "status", "overall", "grade", "stages", "counts", "layers")} | {"findings": sorted((view(f) for f in d["findings"]), key=canonical)} for d in doc["datasets"]]}


def signature(doc: dict) -> str:
    return hashlib.sha256(canonical(payload(doc)).encode()).hexdigest()


def manifest(spark: SparkSession, doc: dict, paths: dict[str, str], as_of: datetime | None = None) -> dict[str, Any]:
    """What is needed to replay a run: each dataset's path (dataset -> path), input hashes, the rules, and what came out."""
    inputs = {n: plain(sinks.input_hash(sinks.input_hashes(spark, p)).head().asDict()) | {"path": p} for n, p in sorted(paths.items())}
    runs = [{k: d[k] for k in ("dataset", "status", "overall", "grade", "counts", "layers")} | {"findings": len(d["findings"])} for d in doc["datasets"]]
    return {"version": VERSION, "generated": doc["generated"], "as_of": plain(as_of), "inputs": inputs, "rules": doc["rules"], "rules_sha256": doc["rules_sha256"], "datasets": runs, "signature": doc["signature"]}


def differences(before: dict, after: dict) -> list[str]:
    """In words, what differs between the datasets of two documents or manifests."""
    size = lambda d: len(d["findings"]) if isinstance(d["findings"], list) else d["findings"]
    old, out = {d["dataset"]: d for d in before["datasets"]}, []
    for d in after["datasets"]:
        o = old.pop(d["dataset"], None)
        if o is None:
            out.append(f"{d['dataset']}: not in the run before")
            continue
        rows, was = {x["layer"]: x["rows"] for x in d["layers"]}, {x["layer"]: x["rows"] for x in o["layers"]}
        out += [f"{d['dataset']}: {n} has {rows.get(n)} rows, had {was.get(n)}" for n in sorted(rows.keys() | was.keys()) if rows.get(n) != was.get(n)]
        if (o["overall"], o["grade"]) != (d["overall"], d["grade"]):
            out.append(f"{d['dataset']}: score {o['overall']} ({o['grade']}) became {d['overall']} ({d['grade']})")
        if size(o) != size(d):
            out.append(f"{d['dataset']}: {size(o)} findings became {size(d)}")
    return out + [f"{n}: not in this run" for n in old]


def verify(spark: SparkSession, saved: dict) -> dict[str, Any]:
    """Replays a manifest: the same inputs and rules must give the same signature.  Changed inputs are named by dataset."""
    as_of = datetime.fromisoformat(saved["as_of"]) if saved.get("as_of") else None
    if digest(saved["rules"]) != saved["rules_sha256"]:
        return {"match": False, "expected": saved["signature"], "actual": None, "differences": ["the manifest's rules were changed"]}
    changed = [n for n, i in saved["inputs"].items() if sinks.input_hash(sinks.input_hashes(spark, i["path"])).head().sha256 != i["sha256"]]
    doc = document(validate(Dataset.open(spark, i["path"]), saved["rules"], as_of) for _, i in sorted(saved["inputs"].items()))
    return {"match": doc["signature"] == saved["signature"], "expected": saved["signature"], "actual": doc["signature"], "differences": [f"{n}: its files changed" for n in changed] + differences(saved, doc)}


def write(spark: SparkSession, value: dict, path: str) -> None:
    """A document or manifest as one JSON file in a folder that Spark can write."""
    spark.createDataFrame([(canonical(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).head()[0])
