"""Rules: defaults with an overlay from JSON (comments allowed, read by Spark), checked strictly; dispositions of findings."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.documents import WEIGHTS
from assay.functions.scoring import STAGE_WEIGHTS
from assay.operators.completeness import REQUIRED
from assay.operators.trust import SEVERITIES

# Severities by rule, thresholds, identifying fields.
SEVERITY = {
    "null_required": "error", "null_optional": "warning", "duplicate_globalid": "critical", "missing_globalid": "critical", "null_globalid": "critical",
    "duplicate_asset_id": "warning", "coded_value": "error", "unmapped_asset_type": "warning", "missing_asset_group": "info", "fuzzy_asset_type": "info",
}
DEFAULTS: dict[str, Any] = {
    "thresholds": {"snap_tolerance_m": 0.001, "near_miss_m": 0.5, "max_sample_ids": 25},
    "required_fields": list(REQUIRED),
    "asset_id_fields": ["ASSETID", "FACILITYID"],
    "weights": {"stages": dict(STAGE_WEIGHTS), "metadata_elements": dict(WEIGHTS)},
    "severities": SEVERITY,
    "domains": {},
}


class RulesError(ValueError):
    """Not usable rules; ``errors`` is a list of sentences."""

    def __init__(self, errors: list[str]):
        self.errors = errors
        super().__init__("; ".join(errors))


def _number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _faults(overlay: dict, base: dict, at: str = "") -> list[str]:
    out = []
    for k, v in overlay.items():
        name = f"{at}{k}"
        if at == "domains.":
            if not isinstance(v, list) or not all(_number(x) or isinstance(x, str) for x in v):
                out.append(f"{name} must be a list of codes")
        elif k not in base:
            out.append(f"{name} is not known")
        elif isinstance(base[k], dict):
            out += _faults(v, base[k], f"{name}.") if isinstance(v, dict) else [f"{name} must be an object"]
        elif isinstance(base[k], list):
            if not isinstance(v, list) or not all(isinstance(x, str) and x.strip() for x in v):
                out.append(f"{name} must be a list of names")
        elif at == "severities.":
            if v not in SEVERITIES:
                out.append(f"{name} must be one of {', '.join(SEVERITIES)}")
        elif k == "max_sample_ids":
            if not isinstance(v, int) or isinstance(v, bool) or not 1 <= v <= 500:
                out.append(f"{name} must be a whole number from 1 to 500")
        elif not _number(v) or v < 0 or v == 0 and at == "weights.stages.":
            out.append(f"{name} must be a {'positive' if at == 'weights.stages.' else 'non-negative'} number")
    return out


def _merged(base: dict, overlay: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in overlay.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def effective(overlay: dict | None = None) -> dict[str, Any]:
    """The defaults with an overlay: objects merge, lists replace.  Unknown names and bad values raise RulesError."""
    if errors := _faults(overlay or {}, DEFAULTS):
        raise RulesError(errors)
    return _merged(DEFAULTS, overlay or {})


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """Effective rules from a JSON file with comments."""
    row = spark.read.option("multiLine", True).option("allowComments", True).json(path).head()
    return effective(row.asDict(recursive=True) if row else {})


def digest(rules: dict) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dispositions(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(finding_id, status, note), checked."""
    bad = [f"{r.get('finding_id')}: not a disposition" for r in rows if not re.fullmatch("[0-9a-f]{8,64}", str(r.get("finding_id"))) or str(r.get("status", "OPEN")).upper() not in ("OPEN", "CLOSED", "ACCEPTED") or len(str(r.get("note") or "")) > 500]
    if bad:
        raise RulesError(bad[:20])
    return spark.createDataFrame([(r["finding_id"], str(r.get("status", "OPEN")).upper(), r.get("note")) for r in rows], "finding_id string, status string, note string").select("finding_id", "status", F.col("note"))
