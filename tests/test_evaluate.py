"""Row tests of a layer in one scan, subtype domains and ids of all layers, against brute force; and how many jobs they take."""

import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assay.operators import uniqueness
from assay.operators.evaluate import RowTest, counted, evaluate, samples
from assay.plans import run
from assay.sources.dataset import Dataset


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice([None, rng.randrange(80)]) if i % 9 == 0 else i, rng.choice(["a", "b", "", None]), rng.choice([None, 1.0, float("nan"), -3.5, 8.0])) for i in range(400)]


@pytest.mark.parametrize("parts", [1, 5])
def test_outcomes_by_brute_force(spark, rows, parts):
    df = spark.createDataFrame(rows, "id long, t string, v double").repartition(parts)
    tests = [RowTest("no t", F.col("t").isNull()), RowTest(("t", 2), F.col("t") == "a", F.col("t").isNotNull(), F.col("t")), RowTest("v", F.col("v") < 2, F.col("v").isNotNull(), F.col("v"), F.min("v")), RowTest("never", F.lit(False)), RowTest("unknown", F.lit(None).cast("boolean"))]
    got = evaluate(df, "id", tests, limit=7, top=2)
    fails = {"no t": lambda r: r[1] is None, ("t", 2): lambda r: r[1] == "a", "v": lambda r: r[2] is not None and r[2] < 2, "never": lambda r: False, "unknown": lambda r: False}
    counts = {("t", 2): sum(r[1] is not None for r in rows), "v": sum(r[2] is not None for r in rows)}
    for name, bad in fails.items():
        mine = [r for r in rows if bad(r)]
        assert (got[name].bad, got[name].of) == (len(mine), counts.get(name, len(rows)))
        assert got[name].ids == sorted({r[0] for r in mine if r[0] is not None})[:7]
    assert got["t", 2].top == [("a", got["t", 2].bad)] and got["v"].extreme == -3.5
    assert [v for v, _ in got["v"].top] == [v for _, v in sorted(((-sum(r[2] == x for r in rows), str(x)) for x in (1.0, -3.5)))]
    assert evaluate(df, "id", []) == {} and evaluate(df.where("false"), "id", tests)["no t"].bad == 0


def test_a_layer_is_scanned_once_and_few_rows_travel(spark, rows, tmp_path):
    spark.createDataFrame(rows, "id long, t string, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tests = [RowTest(i, F.col("v") < i, value=F.col("t") if i == 0 else None) for i in range(40)]
    plan = counted(df, tests)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ArrowEval" not in plan
    plan = samples(df, "id", tests[1:], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("Exchange")  # ranks are cut before the exchange


def test_ids_of_all_layers_by_brute_force(spark):
    rng = random.Random(1)
    layers = {n: [(rng.choice([None, "", *(f"k{i}" for i in range(12))]), rng.choice([None, "x", "y"])) for _ in range(40)] for n in "abc"}
    frames = {n: (spark.createDataFrame(r, "g string, h string"), [("g", F.col("g")), ("h", F.col("h"))] if n != "c" else [("g", F.col("g"))]) for n, r in layers.items()}
    got = {(r.layer, r.field): (r.filled, r.members, r.shared) for r in uniqueness.id_usage(frames).collect()}
    for n, (_, fields) in frames.items():
        for k, (f, _) in enumerate(fields):
            own = [r[k] for r in layers[n] if r[k]]
            others = {r[k] for m, rs in layers.items() if m != n and len(frames[m][1]) > k for r in rs if r[k]}
            assert got[n, f] == (len(own), sum(own.count(v) > 1 for v in own), sum(v in others for v in own))


def _validated(spark, catalog, frames, **more):
    data = Dataset(spark, "d", frames, {k: spark.createDataFrame(*v) for k, v in catalog.items()}, **more)
    return run.validate(data, as_of=datetime(2020, 1, 1))


SUBTYPES = ([
    ("Pipe", "KIND", 1, "Main", "size", "Big"), ("Pipe", "KIND", 2, "Service", None, None), ("Pipe", "KIND", 3, "Stub", "end", "Ends"),
], "layer string, subtype_field string, code long, name string, field string, domain string")


def test_domains_by_subtype(spark):
    rows = [(1, 1, "10", None), (2, 1, "2", "x"), (3, 2, "2", "x"), (4, 2, "10", "x"), (5, 3, "2", " cap "), (6, 3, "9", "open"), (7, None, "77", "z"), (8, 4, "77", "z"), (9, 1, None, None), (10, 1, "x", ""), (11, 3, "1", "open")]
    pipe = spark.createDataFrame(rows, "fid long, Kind int, Size string, End string")
    refs = ([("pipe", "Size", "string", "Small")], "layer string, field string, type string, domain string")
    codes = ([("Big", "10"), ("Big", "20.0"), ("Small", "1"), ("Small", "2"), ("Ends", "cap"), ("Ends", "tee")], "domain string, code string")
    got = _validated(spark, {"references": refs, "subtypes": SUBTYPES, "domain_codes": codes}, {"Pipe": pipe})
    found = {r.message: (r["count"], r.ids, r.detail) for r in got.findings.where("check = 'Coded values'").collect()}
    assert found == {
        "2 values in Size are not in domain Big (subtype Main)": (2, "2,10", "Invalid values: 2, x"), "1 values in Size are not in domain Small (subtype Service)": (1, "4", "Invalid values: 10"),
        "1 values in Size are not in domain Small (subtype Stub)": (1, "6", "Invalid values: 9"), "2 values in end are not in domain Ends (subtype Stub)": (2, "6,11", "Invalid values: open"),
    }
    assert sorted(tuple(r) for r in got.tables["domain_violations"].collect())[0] == ("Pipe", "Size", "Big", "Main", 2)


def test_a_broken_rule_table_fails_its_check_alone(spark):
    refs = ([("Pipe", "Size", "string", "Small")], "layer string, field string, type string, domain string")
    codes = ([("Small",)], "domain string")  # no column of codes
    got = _validated(spark, {"references": refs, "domain_codes": codes}, {"Pipe": spark.createDataFrame([(1, "a", None)], "fid long, Size string, GLOBALID string")})
    by = {}
    for r in got.findings.collect():
        by.setdefault(r.check, []).append(r.message)
    assert any("failed to run" in m for m in by["Coded values"]) and by["Required fields"] == ["1 of 1 values in GLOBALID are blank"]


def test_number_of_jobs_does_not_grow_with_the_tests(spark):
    """Required fields, dates, coded values of a layer: one job to count, one for what failed."""

    def jobs(n):
        df = spark.createDataFrame([(i, *["bad"] * n, *[datetime(2030, 1, 1)] * n) for i in range(5)], "fid long, " + ", ".join(f"F{k} string" for k in range(n)) + ", " + ", ".join(f"D{k} timestamp_ntz" for k in range(n)))
        cat = {"references": ([("L", f"F{k}", "string", "Dom") for k in range(n)], "layer string, field string, type string, domain string"), "domain_codes": ([("Dom", "good")], "domain string, code string")}
        r = run.Run(Dataset(spark, "d", {"L": df}, {k: spark.createDataFrame(*v) for k, v in cat.items()}), as_of=datetime(2020, 1, 1))
        r.layers(), run.needed(r), run.domain_rules(r), run.assignments(r, "L", df)
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "")
        got = r.outcomes("Coded values")["L"]
        spark.sparkContext._jsc.clearJobGroup()
        assert len(got) == n and all(o.bad == 5 and o.ids == [0, 1, 2, 3, 4] for o in got.values())
        assert len(r.outcomes("Date sanity")["L"]) == 2 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)
