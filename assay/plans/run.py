"""A staged validation run: registered checks over a dataset give findings, scores, tables and a grade.

A check is a function of the run.  It adds lazy DataFrames of findings; the few
finding rows (a number that grows with schemas, not with data) are computed at
the end of the check, so that a check that fails becomes a finding of its own.
"""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import scoring
from assay.functions.text import number
from assay.operators import completeness, dates, domains, profiles, references, trust, uniqueness
from assay.operators.evaluate import Outcome, RowTest, evaluate
from assay.plans.rules import digest, effective
from assay.sources.dataset import Dataset


@dataclass(frozen=True)
class Check:
    stage: str
    name: str
    order: int
    fn: Callable
    requires: tuple[str, ...] = ()


_CHECKS: dict[tuple[str, str], Check] = {}
#: What checks ask of each layer's rows: name of the check -> fn(run, layer, df), a list of tests.
_TESTS: dict[str, Callable] = {}


def check(stage: str, name: str, order: int = 100, requires: Iterable[str] = ()):
    """Registers fn(run); a check of the same stage and name is replaced.  Missing modules in ``requires`` skip it."""

    def put(fn):
        _CHECKS[stage, name] = Check(stage, name, order, fn, tuple(requires))
        return fn

    return put


def row_tests(name: str):
    """Registers fn(run, layer, df) -> tests; all tests of a layer are counted in one scan (see Run.outcomes)."""

    def put(fn):
        _TESTS[name] = fn
        return fn

    return put


def load_plugins(paths: Iterable[str]) -> dict[str, str]:
    """Imports check files; path -> error of those that are broken."""
    errors = {}
    for p in paths:
        try:
            spec = importlib.util.spec_from_file_location(f"assay_plugin_{hashlib.sha256(str(p).encode()).hexdigest()[:16]}", p)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
        except Exception as e:  # a broken plugin is reported, the others load
            errors[p] = f"{type(e).__name__}: {e}"
    return errors


@dataclass
class Run:
    """What a check works with: the dataset, the rules, and where findings, scores, tables, flags and notes go."""

    dataset: Dataset
    rules: dict[str, Any] = field(default_factory=effective)
    as_of: datetime = field(default_factory=datetime.now)
    findings: list[tuple] = field(default_factory=list)
    scores: list[tuple] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)
    #: shapes for the map: (layer, id, severity, label, shape), lazily
    flags: list[DataFrame] = field(default_factory=list)
    #: what checks leave to later ones
    state: dict[str, Any] = field(default_factory=dict)
    now: Check | None = None
    cancelled: Callable[[], bool] = lambda: False
    _inventory: list | None = None

    def emit(self, kind: str, **what) -> None:
        self.events.append({"seq": len(self.events), "kind": kind, **what})

    def log(self, text: str, level: str = "info") -> None:
        self.emit("log", check=self.now.name, level=level, text=text)

    def progress(self, share: float, label: str = "") -> None:
        if self.cancelled():
            raise Cancelled
        self.emit("check_progress", check=self.now.name, share=min(1.0, max(0.0, share)), label=label)

    def severity(self, key: str) -> str:
        return self.rules["severities"][key]

    def find(
        self, severity: str, message: str, layer: str = "", count: int | None = None, ids: str = "", detail: str = "", *, check: str = "", rule: str = "", confidence: float = 1.0,
        evidence: str = "", method: str = "", threshold: str = "", affected: int | None = None, action: str = "",
    ) -> None:
        if severity not in trust.SEVERITIES:
            raise ValueError(f"no such severity: {severity}")
        name = check or self.now.name
        self.findings.append((self.dataset.name, self.now.stage, name, severity, layer, message, count, ids, detail, rule, float(confidence), evidence, method, threshold, affected, action))
        self.emit("finding", check=name, severity=severity, layer=layer, message=message)

    def score(self, value: float | None, weight: float = 1.0) -> None:
        self.scores.append((self.now.stage, self.now.name, None if value is None else min(100.0, max(0.0, value)), weight))

    def flag(self, layer: str, shapes: DataFrame, severity: str, label: str, most: int = 200) -> None:
        """Puts shapes (id, g) of a layer on the map: those ``most`` whose ids hash lowest, the same ones in any run."""
        few = trust.hash_sample(shapes.select(F.lit(layer).alias("layer"), F.col("id").cast("string").alias("id"), "g"), "layer", "id", most)
        self.flags.append(few.select("layer", "id", F.lit(severity).alias("severity"), F.lit(label).alias("label"), "g"))

    def outcomes(self, name: str) -> dict[str, dict[Any, Outcome]]:
        """layer -> outcomes of the tests registered under name; the tests of all checks are counted in one scan a layer, once a run."""
        if "outcomes" not in self.state:
            found: dict[str, dict[str, dict]] = {}
            errors: dict[str, Exception] = {}
            for layer, df in self.layers().items():
                every = []
                for who, fn in _TESTS.items():
                    try:
                        every += [replace(t, name=(who, t.name)) for t in fn(self, layer, df)]
                    except Exception as e:  # it is that check's failure alone
                        errors.setdefault(who, e)
                for (who, test), o in evaluate(df, df.columns[0], every, self.rules["thresholds"]["max_sample_ids"]).items():
                    found.setdefault(who, {}).setdefault(layer, {})[test] = o
            self.state["outcomes"] = found, errors
        found, errors = self.state["outcomes"]
        if name in errors:
            raise errors[name]
        return found.get(name, {})

    def inventory(self) -> list:
        """(layer, rows, fields, readable, system), counted once a run: a row for each table."""
        if self._inventory is None:
            self._inventory = self.dataset.layers().collect()
        return self._inventory

    def layers(self, kind: str | None = None) -> dict[str, DataFrame]:
        """The tables to check; kind: those alone whose geometry is of that kind."""
        ok = [r.layer for r in self.inventory() if not r.system and r.readable and r.rows]
        return {n: self.dataset.frames[n] for n in ok if kind is None or kind in self.dataset.geometry.get(n, "").lower()}

    def rows(self, layer: str) -> int:
        return next((r.rows for r in self.inventory() if r.layer.lower() == layer.lower()), 0)

    def fields(self, df: DataFrame) -> dict[str, str]:
        return {c.lower(): c for c in df.columns}

    def ids(self, bad: DataFrame, id_col: str) -> str:
        """The smallest distinct ids of bad rows, as many as the rules allow."""
        few = bad.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy("id").limit(self.rules["thresholds"]["max_sample_ids"])
        return ",".join(str(r.id) for r in few.collect())


class Cancelled(Exception):
    """The caller wants the run to stop."""


@dataclass
class Result:
    dataset: str
    status: str
    findings: DataFrame
    stages: dict[str, float | None]
    score: float | None
    grade: str
    tables: dict[str, DataFrame]
    events: list[dict]
    rules: dict[str, Any]
    rules_sha256: str
    layers: list[tuple[str, int]]
    flags: DataFrame | None = None


def validate(dataset: Dataset, rules: dict | None = None, as_of: datetime | None = None, stages: Iterable[str] = trust.STAGES, cancelled: Callable[[], bool] = lambda: False) -> Result:
    """All registered checks of the stages, in order; a check that raises is reported and the run goes on; a cancelled run keeps what it has."""
    run = Run(dataset, rules or effective(), as_of or datetime.now(), cancelled=cancelled)
    run.emit("job_start", dataset=dataset.name)
    status = "ok" if dataset.frames else "failed"
    for stage in stages:
        if status == "cancelled":
            break
        run.emit("stage_start", stage=stage)
        for c in sorted((c for c in _CHECKS.values() if c.stage == stage), key=lambda c: (c.order, c.name)):
            if any(importlib.util.find_spec(m) is None for m in c.requires):
                run.emit("check_skipped", check=c.name)
                continue
            run.now = c
            run.emit("check_start", check=c.name)
            before = len(run.findings), len(run.scores)
            try:
                if cancelled():
                    raise Cancelled
                c.fn(run)
            except Cancelled:
                status = "cancelled"
                break
            except Exception as e:
                del run.findings[before[0] :], run.scores[before[1] :]
                run.emit("check_error", check=c.name, error=f"{type(e).__name__}: {e}"[:300])
                run.find("warning", f"Check failed to run: {type(e).__name__}", detail=str(e)[:300])
            run.emit("check_end", check=c.name, findings=len(run.findings) - before[0])
        run.emit("stage_end", stage=stage)
    by_stage = {s: scoring.weighted_mean([(v, w) for t, _, v, w in run.scores if t == s]) for s in scoring.STAGE_WEIGHTS}
    total = scoring.overall(by_stage, run.rules["weights"]["stages"]) if status != "failed" else None
    run.emit("job_end", score=total, status=status)
    found = trust.detailed(dataset.spark.createDataFrame(run.findings, f"{trust.BASE}, {trust.MORE}"))
    layers = sorted((r.layer, r.rows) for r in run.inventory() if not r.system)
    return Result(dataset.name, status, found, by_stage, total, scoring.grade_of(total), run.tables, run.events, run.rules, digest(run.rules), layers, trust.union(*run.flags) if run.flags else None)


def mean_score(results: Iterable[Result]) -> float | None:
    """The mean of the datasets' scores; failed datasets and those without a score are left out."""
    return scoring.weighted_mean((r.score, 1.0) for r in results if r.status != "failed")


# ---- built-in checks ------------------------------------------------------------------------------


@check("discover", "Inventory", 10)
def inventory(run: Run) -> None:
    run.tables["layers"] = run.dataset.layers()
    for r in run.inventory():
        if r.readable and not r.rows and not r.system:
            run.find("info", f"{r.layer} is empty", r.layer, 0)
        elif not r.readable:
            run.find("info" if r.layer.lower().startswith("view_") else "error", f"{r.layer} cannot be read", r.layer, detail=run.dataset.errors.get(r.layer, ""))
    if all(r.system or not r.readable for r in run.inventory()):
        run.find("warning", "The dataset has no user layers")


@check("discover", "Field profile", 90)
def profile(run: Run) -> None:
    parts = [profiles.field_profile(df, n) for n, df in run.layers().items()]
    if not parts:
        return
    run.tables["profile"] = fields = trust.union(*parts)
    for r in profiles.layer_profile(fields).collect():
        if r.weak_fields:
            run.find("info", f"{r.layer} has fields that are blank on at least 20% of rows", r.layer, len(r.weak_fields.split(",")), detail=r.weak_fields)


@check("quality", "Layer readability", 5)
def readability(run: Run) -> None:
    mine = [r for r in run.inventory() if not r.system and not r.layer.lower().startswith("view_")]
    run.score(100.0 * sum(r.readable for r in mine) / len(mine) if mine else None)


def needed(run: Run) -> dict[str, dict[str, Any]]:
    """layer -> field -> why it must be filled: configured, or demanded by the catalog's ``class_fields`` (class, field, type, nullable, required)."""
    if "needed" not in run.state:
        spark = run.dataset.spark
        declared = run.dataset.catalog.get("class_fields")
        found = spark.createDataFrame([(n, f, "") for n, df in run.layers().items() for f in df.columns] or [("", "", "")], "layer string, name string, type string")
        if declared is None:
            listed = found.withColumns({"nullable": F.lit(True), "required": F.lit(False)})
        else:
            said = declared.select(F.lower("class").alias("k"), F.lower("field").alias("f"), F.col("type").alias("t"), "nullable", "required")
            listed = found.join(said, (F.lower("layer") == F.col("k")) & (F.lower("name") == F.col("f")), "left").select("layer", "name", F.coalesce("t", "type").alias("type"), "nullable", "required")
        out: dict[str, dict[str, Any]] = {}
        for r in completeness.required_fields(listed, run.rules["required_fields"]).orderBy("layer", "name").collect():
            out.setdefault(r.layer, {})[r.name] = r
        run.state["needed"] = out
    return run.state["needed"]


@row_tests("Required fields")
def blank_tests(run: Run, layer: str, df: DataFrame) -> list[RowTest]:
    return [RowTest(f, test) for f, test in completeness.blanks(df, list(needed(run).get(layer, {}))).items()]


@check("quality", "Required fields", 10)
def required(run: Run) -> None:
    bad = total = 0
    for name, outcomes in run.outcomes("Required fields").items():
        for f, o in outcomes.items():
            why = needed(run)[name][f]
            bad, total = bad + o.bad, total + o.of
            if o.bad:
                strict = why.configured or not why.nullable
                sev = run.severity("null_globalid" if f.upper() == "GLOBALID" else "null_required" if strict else "null_optional")
                run.find(sev, f"{o.bad} of {o.of} values in {f} are blank", name, o.bad, ",".join(map(str, o.ids)))
    run.score(scoring.penalty_of(bad, total), 2)


@check("quality", "Duplicate ids", 20)
def duplicates(run: Run) -> None:
    """GlobalIDs and asset ids that repeat in a layer or across layers: the ids of all layers are counted in one job."""
    bad = total = 0.0
    layers, keys = run.layers(), {}
    for name, df in layers.items():
        have = run.fields(df)
        mine = [("globalid", uniqueness.guid(F.col(have["globalid"]).cast("string")))] if "globalid" in have else []
        for f in run.rules["asset_id_fields"]:
            if f.lower() in have:
                col = have[f.lower()]
                mine.append((f, F.when(~completeness.blanks(df, [col])[col], F.col(col).cast("string"))))
        if mine:
            keys[name] = df, mine
    used = {(r.layer, r.field): r for r in uniqueness.id_usage(keys).collect()} if keys else {}
    shared = 0
    for name, df in layers.items():
        have = run.fields(df)
        if "globalid" in have:
            r = used.get((name, "globalid"))
            n, shared = (r.members if r else 0), shared + (r.shared if r else 0)
            bad, total = bad + n, total + run.rows(name)
            if n:
                key = df.select(uniqueness.guid(F.col(have["globalid"]).cast("string")).alias("gid"), F.col(df.columns[0]).alias("__id")).where("gid <> ''")
                run.find(run.severity("duplicate_globalid"), f"{n} rows share a GlobalID", name, n, run.ids(uniqueness.repeated_rows(key, ["gid"]), "__id"))
        elif name in run.dataset.geometry:
            run.find(run.severity("missing_globalid"), f"{name} has no GlobalID field", name, run.rows(name))
        for f in run.rules["asset_id_fields"]:
            if r := used.get((name, f)):
                bad, total = bad + 0.25 * r.members, total + r.filled
                if r.members:
                    run.find(run.severity("duplicate_asset_id"), f"{r.members} rows share a {f}", name, r.members)
    if shared:
        bad += shared
        run.find("critical", f"{shared} rows have a GlobalID that another layer has too", count=shared)
    run.score(scoring.penalty_of(bad, total), 2)


@row_tests("Date sanity")
def date_tests(run: Run, layer: str, df: DataFrame) -> list[RowTest]:
    late, early = F.lit(run.as_of).cast("timestamp_ntz") + F.expr("interval 1 day"), F.lit(dates.FLOOR).cast("timestamp_ntz")
    out = []
    for c in dates.date_columns(df):
        d = dates.as_date(df, c)
        out += [RowTest((c, "in the future"), d > late, d.isNotNull(), extreme=F.max(F.when(d > late, d))), RowTest((c, "before 1850"), d < early, F.lit(False), extreme=F.min(F.when(d < early, d)))]
    return out


@check("quality", "Date sanity", 60)
def date_sanity(run: Run) -> None:
    bad = total = 0
    for name, outcomes in run.outcomes("Date sanity").items():
        for (f, what), o in outcomes.items():
            bad, total = bad + o.bad, total + o.of
            if o.bad:
                run.find("warning", f"{o.bad} dates in {f} are {what}", name, o.bad, ",".join(map(str, o.ids)), str(o.extreme))
    run.score(scoring.penalty_of(bad, total), 0.5)


@check("quality", "Associations", 80)
def associations(run: Run) -> None:
    """A catalog table ``associations`` (layer, end, target, key) names references; its ends must exist in the target's key."""
    table = run.dataset.catalog.get("associations")
    for r in table.collect() if table is not None else ():
        df, target = run.dataset.layer(r.layer), run.dataset.layer(r.target)
        lost, total = references.orphans(df, [r.end], references.known_ids((target, r.key))).count(), df.count()
        if lost:
            run.find("error", f"{lost} rows refer to {r.target} rows that do not exist", r.layer, lost)
        run.score(max(0.0, 100.0 - min(30.0, 300.0 * lost / total)) if total else None)


def domain_rules(run: Run) -> dict[str, Callable]:
    """domain -> condition that a value breaks it, from ``domain_codes`` (domain, code), ``domain_ranges`` (domain, min, max) and the rules' own codes."""
    if "domain_rules" not in run.state:
        codes, ranges = run.dataset.catalog.get("domain_codes"), run.dataset.catalog.get("domain_ranges")
        extra = [(d, str(c)) for d, cs in run.rules["domains"].items() for c in cs]
        if codes is not None and extra:
            codes = codes.select("domain", "code").unionByName(run.dataset.spark.createDataFrame(extra, "domain string, code string"))
        out: dict[str, Callable] = {}
        if codes is not None:
            known: dict[str, tuple[bool, list]] = {}
            for r in domains.code_keys(codes).orderBy("domain", "key").collect():  # a row for each code of the schema
                known.setdefault(r.domain, (r.numeric, []))[1].append(r.key)
            out = {d: (lambda v, keys=keys, numeric=numeric: domains.breaks_codes(v, keys, numeric)) for d, (numeric, keys) in known.items()}
        for r in ranges.collect() if ranges is not None else ():
            out[r.domain] = lambda v, low=r["min"], high=r["max"]: domains.breaks_range(v, low, high)
        run.state["domain_rules"] = out
    return run.state["domain_rules"]


def assignments(run: Run, layer: str, df: DataFrame) -> list[tuple[str, str, Any, str | None, Column]]:
    """(field, domain, subtype's code, its name, condition on the row): which rows' values a domain holds for.

    ``references`` (layer, field, type, domain) gives a field's domain.  A layer in ``subtypes``
    (layer, subtype_field, code, name, field, domain) is looked at by subtype: a subtype's own domain for a field comes
    before the field's, and rows of no known subtype have none.
    """
    if "assigned" not in run.state:
        refs, subs = run.dataset.catalog.get("references"), run.dataset.catalog.get("subtypes")
        run.state["assigned"] = [t.collect() if t is not None else [] for t in (refs, subs)]
    refs, subs = ([r for r in t if r.layer.lower() == layer.lower()] for t in run.state["assigned"])
    have, plain = run.fields(df), {r.field.lower(): r.domain for r in refs if r.domain}
    kinds: dict[Any, tuple[str | None, dict[str, str]]] = {}
    for r in subs:
        own = kinds.setdefault(r.code, (r.name, {}))[1]
        if r.field and r.domain:
            own[r.field.lower()] = r.domain
    key = next((have[r.subtype_field.lower()] for r in subs if r.subtype_field and r.subtype_field.lower() in have), None)
    said = {r.field.lower(): r.field for r in (*subs, *refs) if r.field}  # as the catalog spells it
    out = []
    for f in sorted({*plain, *(f for _, own in kinds.values() for f in own)} & set(have)):
        if kinds:
            for code, (name, own) in kinds.items():
                if domain := own.get(f, plain.get(f)):
                    here = F.lit(True) if key is None else F.coalesce(number(F.col(f"`{key}`")) == float(code), F.lit(False))
                    out.append((said[f], domain, code, name, here))
        elif f in plain:
            out.append((said[f], plain[f], None, None, F.lit(True)))
    return out


@row_tests("Coded values")
def coded_tests(run: Run, layer: str, df: DataFrame) -> list[RowTest]:
    rules, have, out = domain_rules(run), run.fields(df), []
    for f, domain, code, name, here in assignments(run, layer, df):
        value = F.col(f"`{have[f.lower()]}`").cast("string")
        some = here & value.isNotNull()
        broken = rules[domain](value) if domain in rules else F.lit(False)
        out.append(RowTest((f, domain, code, name), some & broken, some, value))
    return out


@check("schema", "Coded values", 20)
def coded(run: Run) -> None:
    """Values in fields with a domain must be codes of it or lie in its range, by subtype where the layer has subtypes."""
    if run.dataset.catalog.get("references") is None and run.dataset.catalog.get("subtypes") is None:
        return
    bad, total, rows = 0, 0, []
    for layer, outcomes in run.outcomes("Coded values").items():
        for (f, domain, _, subtype), o in outcomes.items():
            bad, total = bad + o.bad, total + o.of
            if o.bad:
                rows.append((layer, f, domain, subtype, o.bad))
                more = f" (subtype {subtype})" if subtype else ""
                run.find(run.severity("coded_value"), f"{o.bad} values in {f} are not in domain {domain}{more}", layer, o.bad, ",".join(map(str, o.ids)), f"Invalid values: {', '.join(str(v) for v, _ in o.top)}")
        if layer in run.dataset.geometry and any(o.bad for o in outcomes.values()):
            df, wrong = run.layers()[layer], F.lit(False)
            for t in coded_tests(run, layer, df):
                wrong = wrong | F.coalesce(t.bad, F.lit(False))
            if "geometry" in run.fields(df):
                run.flag(layer, checks.shapes(run, layer, wrong), "error", "value outside domain", 150)
    run.tables["domain_violations"] = run.dataset.spark.createDataFrame(rows, "layer string, field string, domain string, subtype string, invalid long")
    run.score(scoring.penalty_of(bad, total), 2)


from assay.plans import checks  # noqa: E402, F401  (registers the other checks)
