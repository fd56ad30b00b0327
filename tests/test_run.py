"""The staged run over a small dataset with planted defects; rules; plugins; geometry, documents, streams and sinks."""

import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assay.functions import documents, geometry, scoring, text
from assay.operators import network, profiles, references, trust, uniqueness
from assay.plans import rules, run
from assay.sources import dataset, sinks
from assay.streaming import events


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, "{AB-1}", 1, "A-1", "2999-01-01", 1), (2, " ab-1 ", 1, "A-2", "1800-01-01", 1), (3, "C", None, "A-3", None, 1), (4, "D", 2, "A-1", "2000-01-01", 2), (5, None, 9, "", "2001-01-01", 1), (6, "E", 1, None, "2001-01-01", 1)]
    return spark.createDataFrame(rows, "fid long, GLOBALID string, ASSETGROUP int, ASSETID string, installed string, ISCONNECTED int").withColumn("installed", F.col("installed").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def sample(spark, lines):
    points = spark.createDataFrame([(1, "c", 5.0), (2, "z", float("nan"))], "fid long, globalid string, v double")
    catalog = {"references": spark.createDataFrame([("Lines", "ASSETGROUP", "int", "Group")], "layer string, field string, type string, domain string"), "domain_codes": spark.createDataFrame([("Group", "1"), ("Group", "2")], "domain string, code string")}
    return dataset.Dataset(spark, "sample", {"Lines": lines, "Points": points, "Empty": points.limit(0), "GDB_Items": points}, catalog, {"view_x": "gone"})


def _found(result, check):
    return {(r.layer, r.message): r for r in result.findings.where(F.col("check") == check).collect()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_validate_is_the_same_for_any_partitioning(sample, parts):
    d = dataset.Dataset(sample.spark, "sample", {n: f.repartition(parts) for n, f in sample.frames.items()}, sample.catalog, sample.errors)
    got = run.validate(d, as_of=datetime(2020, 1, 1))
    nulls = _found(got, "Required fields")
    assert nulls["Lines", "1 of 6 values in GLOBALID are blank"].severity == "critical" and nulls["Lines", "1 of 6 values in GLOBALID are blank"].ids == "5"
    assert nulls["Lines", "1 of 6 values in ASSETGROUP are blank"].ids == "3"
    dup = _found(got, "Duplicate ids")
    assert dup["Lines", "2 rows share a GlobalID"].ids == "1,2" and dup["Lines", "2 rows share a ASSETID"].severity == "warning"
    assert dup["", "2 rows have a GlobalID that another layer has too"]["count"] == 2
    when = _found(got, "Date sanity")
    assert ("Lines", "1 dates in installed are in the future") in when and ("Lines", "1 dates in installed are before 1850") in when
    coded = _found(got, "Coded values")["Lines", "1 values in ASSETGROUP are not in domain Group"]
    assert coded.ids == "5" and coded.detail == "Invalid values: 9"
    assert got.grade == scoring.grade_of(got.score) and got.stages["metadata"] is None and got.stages["quality"] is not None
    assert trust.signature(got.findings).head().signature == trust.signature(run.validate(sample, as_of=datetime(2020, 1, 1)).findings).head().signature
    assert [e["seq"] for e in got.events] == list(range(len(got.events)))


def test_rules_and_plugins(spark, sample, tmp_path):
    (tmp_path / "rules.json").write_text('{"severities": {"coded_value": "info"}, /* one more */ "thresholds": {"max_sample_ids": 1}} // end')
    got = rules.load(spark, str(tmp_path / "rules.json"))
    assert got["severities"]["coded_value"] == "info" and got["severities"]["null_required"] == "error" and got["thresholds"]["snap_tolerance_m"] == 0.001
    assert {r.severity for r in _found(run.validate(sample, got), "Coded values").values()} == {"info"}
    assert "Coded values" not in {r.check for r in run.validate(sample, rules.effective({"domains": {"Group": [9]}})).findings.collect()}
    with pytest.raises(rules.RulesError) as e:
        rules.effective({"nope": 1, "thresholds": {"max_sample_ids": 0}, "weights": {"stages": {"quality": 0}}, "severities": {"coded_value": "bad"}})
    assert len(e.value.errors) == 4
    with pytest.raises(rules.RulesError):
        rules.dispositions(spark, [{"finding_id": "xyz", "status": "OPEN"}])
    (tmp_path / "good.py").write_text("from assay.plans.run import check\n@check('quality', 'Mine', 200)\ndef mine(run):\n    run.find('warning', 'seen')\n@check('quality', 'Breaks')\ndef breaks(run):\n    raise ValueError('x')\n@check('quality', 'Skipped', requires=('no_such_module',))\ndef skipped(run):\n    run.find('error', 'never')\n")
    (tmp_path / "bad.py").write_text("def (")
    assert list(run.load_plugins([str(tmp_path / "good.py"), str(tmp_path / "bad.py")])) == [str(tmp_path / "bad.py")]
    messages = {r.message for r in run.validate(sample).findings.collect()}
    assert "seen" in messages and "Check failed to run: ValueError" in messages and "never" not in messages
    for k in (("quality", "Mine"), ("quality", "Breaks"), ("quality", "Skipped")):
        run._CHECKS.pop(k)


def test_scores():
    assert scoring.penalty_of(1, 100) == 90 and scoring.penalty_of(0, 0) is None and scoring.penalty_of(50, 100) == 0
    assert scoring.weighted_mean([(100, 1), (None, 5), (50, 1)]) == 75 and scoring.overall({"quality": 80.0}) == 80
    assert [scoring.grade_of(s) for s in (90, 89.9, 70, 60, 59.9, None)] == ["A", "B", "C", "D", "F", "n/a"]


def test_geometry(spark):
    wkb = struct.pack("<BIIdddd", 1, 2, 2, 0, 0, 3, 4)
    got = spark.createDataFrame([(1, bytearray(wkb)), (2, None), (3, bytearray(b"junk"))], "id int, w binary").select("id", geometry.from_wkb("w").alias("g"))
    rows = {r.id: r for r in got.select("id", geometry.length(F.col("g")).alias("n"), geometry.is_empty(F.col("g")).alias("e"), F.size(geometry.ends(F.col("g"))).alias("k")).collect()}
    assert (rows[1].n, rows[1].e, rows[1].k) == (5.0, False, 2) and rows[2].e and rows[3].e
    assert geometry._reason("polygon", [[[{"x": x, "y": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]]]) is None
    assert geometry._reason("line", [[[{"x": 1.0, "y": 1.0}] * 2]]) == "Too few points in geometry component"


def _polygons(*parts):
    return [[[{"x": float(x), "y": float(y), "z": None} for x, y in ring] for ring in part] for part in parts]


def _box(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def test_polygons_with_holes_and_parts(spark):
    two, holed = _polygons([_box(0, 0, 2)], [_box(5, 0, 2)]), _polygons([_box(0, 0, 4), _box(1, 1, 1)])
    frame = spark.createDataFrame([(1, two), (2, holed), (3, []), (4, None)], f"id int, g {geometry.SHAPE}")
    rows = {r.id: r for r in frame.select("id", geometry.area(F.col("g")).alias("a"), geometry.geojson(F.lit("polygon"), F.col("g"), F.struct("id")).alias("j")).collect()}
    assert [rows[k].a for k in (1, 2, 3, 4)] == [8.0, 15.0, 0.0, 0.0]
    shapes = {k: json.loads(rows[k].j)["geometry"] for k in rows}
    assert (shapes[1]["type"], len(shapes[1]["coordinates"])) == ("MultiPolygon", 2) and shapes[3] is None and shapes[4] is None
    assert (shapes[2]["type"], len(shapes[2]["coordinates"])) == ("Polygon", 2)
    reason = lambda *parts: geometry._reason("polygon", _polygons(*parts))
    assert reason([_box(0, 0, 4), _box(1, 1, 1)], [_box(5, 0, 2)]) is None and reason([_box(0, 0, 2)], [_box(2, 2, 2)]) is None
    assert reason([_box(0, 0, 2), _box(5, 5, 1)]) == "Hole lies outside shell"
    assert reason([_box(0, 0, 4)], [_box(1, 1, 1)]) == "Nested shells" and reason([_box(0, 0, 4), _box(1, 1, 2)], [_box(1.5, 1.5, 1)]) is None
    assert reason([_box(0, 0, 2)], [_box(1, 1, 2)]) == "Self-intersection" and reason([_box(0, 0, 9), _box(1, 1, 5), _box(2, 2, 1)]) == "Holes are nested"
    raw = b"".join([struct.pack("<BII", 1, 6, 2), *[struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *v) for v in _box(x, 0, 2)) for x in (0, 5)]])
    assert [[[tuple(v) for v in ring.tolist()] for ring in part] for part in geometry._parts(raw)] == [[[(float(x), float(y)) for x, y in _box(k, 0, 2)]] for k in (0, 5)]
    line = spark.createDataFrame([([[[{"x": x, "y": 0.0, "z": None} for x in (0.0, 0.1, 0.2, 1.0, 1.05, 2.0)]]],)], f"g {geometry.SHAPE}")
    assert [v.x for v in line.select(geometry.simplified(F.col("g"), 0.5).alias("g")).head().g[0][0]] == [0.0, 1.0, 2.0]


def test_wkb_of_all_kinds(spark):
    """Both byte orders, heights and measures in both codings, holes, multi kinds, empty and damaged shapes."""

    def body(order, kind, rows, head=b""):
        return (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", kind) + head + (b"" if (kind & 0xFFFF) % 1000 == 1 else struct.pack(order + "I", len(rows))) + b"".join(struct.pack(f"{order}{len(r)}d", *r) for r in rows)

    ring = lambda rows, order="<": struct.pack(order + "I", len(rows)) + b"".join(struct.pack(order + "2d", *r) for r in rows)
    nan = float("nan")
    hole = struct.pack("<BII", 1, 3, 2) + ring(_box(0, 0, 9)) + ring(_box(1, 1, 2))
    every = [
        (body("<", 1, [(1, 2)]), [[[(1, 2, None)]]]), (body(">", 1, [(1, 2)]), [[[(1, 2, None)]]]), (body(">", 1001, [(1, 2, 3)]), [[[(1, 2, 3)]]]), (body("<", 2001, [(1, 2, 7)]), [[[(1, 2, None)]]]),
        (body("<", 3002, [(1, 2, 3, 7), (4, 5, 6, 7)]), [[[(1, 2, 3), (4, 5, 6)]]]), (body("<", 0xA0000001, [(1, 2, 3)], struct.pack("<I", 4326)), [[[(1, 2, 3)]]]), (body("<", 0x40000001, [(1, 2, 9)]), [[[(1, 2, None)]]]),
        (body("<", 1, [(nan, nan)]), []), (body("<", 2, []), []), (struct.pack("<BII", 1, 3, 0), []), (hole, [[[(*v, None) for v in _box(0, 0, 9)], [(*v, None) for v in _box(1, 1, 2)]]]),
        (struct.pack("<BII", 1, 4, 2) + body("<", 1, [(1, 2)]) + body(">", 1001, [(3, 4, 5)]), [[[(1, 2, None)]], [[(3, 4, 5)]]]), (struct.pack("<BII", 1, 3, 1) + ring([]), [[[]]]),
        (hole[:-1], None), (b"", None), (b"\x01", None), (b"junk", None), (struct.pack("<BII", 1, 6, 4_000_000_000), None), (None, None),
    ]
    frame = spark.createDataFrame([(i, None if w is None else bytearray(w)) for i, (w, _) in enumerate(every)], "id int, w binary")
    got = {r.id: r.g for r in frame.select("id", geometry.from_wkb("w").alias("g")).collect()}
    plain = lambda g: None if g is None else [[[tuple(v) for v in r] for r in p] for p in g]
    assert [plain(got[i]) for i in range(len(every))] == [want for _, want in every]
    assert frame.limit(0).select(geometry.from_wkb("w")).count() == 0


def test_rows_of_the_grid_grow_with_the_segments(spark):
    """However long the segments are, each covers a few dozen cells."""
    for n in (100, 1000, 10_000):
        s = spark.range(n).selectExpr("id as owner", "rand(1) * 100 as x1", "rand(2) * 100 as y1", "rand(3) * 100 as x2", "rand(4) * 100 as y2").withColumn("layer", F.lit("L"))
        base, longest = network.extent(s)
        assert network.covered(s, 0.001, base).count() < 3 * network.REACH * n and longest <= 100


def test_connectivity_against_brute_force(spark):
    import random

    rng = random.Random(3)
    segs = [(i % 9, *(rng.choice([round(rng.uniform(0, 6), 1), 1.0, 2.0]) for _ in range(4))) for i in range(80)]
    frame = spark.createDataFrame([("L", *s) for s in segs], "layer string, owner long, x1 double, y1 double, x2 double, y2 double")
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))

    def d2(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / size)) if size else 0.0
        return (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2

    for snap, near, cell in ((0.001, 0.5, None), (0.1, 0.3, 0.7), (0.05, 0.06, 5.0)):
        want = {}
        for o, x1, y1, x2, y2 in segs:
            for p in ((x1, y1), (x2, y2)):
                d = min(d2(*p, *s[1:]) for s in segs if s[0] != o)
                want[o, *p] = "connected" if d <= snap * snap else "near miss" if d <= near * near else "dangle"
        got = network.endpoint_states(frame.withColumn("ends", ends), snap=snap, near=near).collect()
        assert {(r.owner, r.x, r.y): r.state for r in got} == want


def test_nulls_empty_tables_and_repeats(spark, lines):
    none = lines.limit(0)
    assert uniqueness.repeated_summary(none, ["fid"]).head().members == 0
    assert references.orphans(none, ["GLOBALID"], references.known_ids((none, "GLOBALID"))).count() == 0
    assert profiles.field_profile(none, "x").where("key_candidate").count() == 0
    twice = lines.unionByName(lines)
    assert references.orphans(twice, ["GLOBALID"], references.known_ids((lines.where("fid = 1"), "GLOBALID"))).count() == 8  # null ends are orphans


def test_documents():
    assert documents.evaluate("<a>")["summary"] == "missing" and documents.evaluate(None)["standard"] is None
    full = "<metadata><idinfo><purpose>why</purpose><bounding><w>1</w><e>2</e><n>3</n><s>4</s></bounding></idinfo></metadata>"
    got = documents.evaluate(full)
    assert (got["summary"], got["extent"], got["standard"], got["tags"]) == ("present", "present", "FGDC CSDGM", "missing")
    nested = documents.evaluate("<metadata><a><idinfo><descript><abstract>Water mains</abstract><purpose>Ops</purpose></descript></idinfo></a></metadata>")
    assert (nested["standard"], nested["description"], nested["summary"]) == ("FGDC CSDGM", "present", "present")
    iso = documents.evaluate('<g:MD_Metadata xmlns:g="urn:g"><g:abstract><g:t>Mains</g:t></g:abstract></g:MD_Metadata>')
    assert (iso["standard"], iso["description"]) == ("ISO 19139", "present")
    hollow = documents.evaluate("<metadata><dataIdInfo><idPurp>TBD</idPurp><idAbs>&amp;lt;p&amp;gt;&amp;lt;/p&amp;gt;</idAbs><idPoC>n/a</idPoC></dataIdInfo></metadata>")
    assert (hollow["summary"], hollow["description"], hollow["contact"]) == ("placeholder", "missing", "missing")
    auto = documents.evaluate("<metadata><x><Esri><DataProperties><lineage><Process>Append</Process></lineage></DataProperties></Esri></x></metadata>")
    assert auto["lineage"] == "auto" and auto["standard"] == "ArcGIS"
    bounds = documents.evaluate("<metadata><GeoBndBox><w>10 W</w><e>20 E</e><n>3</n><s>4</s></GeoBndBox></metadata>")
    assert bounds["extent"] == "present" and bounds["standard"] == "Unknown"
    assert documents.evaluate("<!DOCTYPE a [<!ENTITY x SYSTEM 'file:///etc/passwd'>]><a><purpose>&x;</purpose></a>")["summary"] == "missing"


def test_streaming_counts_and_sinks(spark, lines, tmp_path):
    src = str(tmp_path / "in")
    lines.select("fid", F.col("installed").cast("timestamp").alias("ts"), "ASSETID").where("fid in (4, 5, 6)").write.parquet(src)
    stream = spark.readStream.schema("fid long, ts timestamp, ASSETID string").parquet(src)
    q = events.blank_counts(stream, "ts", ["ASSETID"]).writeStream.format("memory").queryName("blanks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.rows, r.ASSETID_empty) for r in spark.table("blanks").collect()) == [(1, 0), (2, 2)]
    sinks.write_csv(spark.createDataFrame([("=1+1", 1)], "a string, b int"), str(tmp_path / "out"))
    assert "'=1+1,1" in spark.read.text(str(tmp_path / "out")).agg(F.array_join(F.collect_list("value"), "\n")).head()[0]
    sinks.write_html(spark, "<t>", {"s": spark.createDataFrame([("<b>",)], "a string")}, str(tmp_path / "page"))
    assert "&lt;b&gt;" in spark.read.text(str(tmp_path / "page")).head()[0]
    assert sinks.input_hash(sinks.input_hashes(spark, src)).head().files >= 1


def test_text(spark):
    assert json.loads(spark.range(1).select(F.to_json(F.struct(text.guid(F.lit(" {a-b} ")).alias("g"), text.short_name(F.lit("db.x.y")).alias("s"), text.path_tail(F.lit("/a/b/c/d")).alias("p"), text.type_family(F.lit("esriFieldTypeSingle")).alias("f")))).head()[0]) == {"g": "A-B", "s": "y", "p": "b/c/d", "f": "float"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines_of(rows, kind="long"):
    """Lines (layer, owner, x1, y1, x2, y2, ends), a row each."""
    from pyspark.sql import SparkSession

    frame = SparkSession.getActiveSession().createDataFrame(rows, f"layer string, owner {kind}, x1 double, y1 double, x2 double, y2 double")
    return frame.withColumn("ends", F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))


def test_connectivity_broadcasts_no_rows_of_the_grid(spark):
    """Small tables too make many rows on the grid: a broadcast of them fills the driver."""
    states = network.endpoint_states(_lines_of([("L", i, 0.0, float(i), 90.0, float(i)) for i in range(20)]))
    assert "Broadcast" not in _plan(network.connectivity(states)) and network.connectivity(states).head().dangles == 40


def test_equal_ends_and_segments_of_many_owners(spark):
    """Ends that owners share, an owner's own repeats, null owners and NaN, against brute force."""
    nan = float("nan")
    rows = [("L", o, 0.0, 0.0, 5.0, 0.0) for o in (1, 2, 3)] + [("L", 4, 20.0, 0.0, 25.0, 0.0)] * 2 + [("M", 4, 25.0, 0.0, 30.0, 0.0), ("L", None, 40.0, 0.0, 45.0, 0.0), ("L", None, 45.0, 0.0, 50.0, 0.0)]
    rows += [("L", 5, 50.0, 0.0, 55.0, 0.3), ("L", 6, 2.5, 0.0005, 2.5, 9.0), ("L", 6, 2.5, 9.3, nan, 1.0), ("L", 7, 2.5, 9.3, 8.0, 9.3), ("L", 8, 22.0, 0.4, 22.0, 7.0), ("L", 8, 22.0, 0.4, 28.0, 7.0)]

    def d2(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        return (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2

    want = {}
    for layer, o, *s in rows:
        for p in (tuple(s[:2]), tuple(s[2:])):
            d = min((d2(*p, *other) for _, o2, *other in rows if o2 != o and nan not in other and p == p and not any(v != v for v in (*other, *p))), default=9.0)
            state = "connected" if d <= 1e-6 else "near miss" if d <= 0.25 else "dangle"
            key = (layer, o, *map(str, p))
            want[key] = (want.get(key, (0,))[0] + 1, state)
    for kind in ("long", "string"):
        named = rows if kind == "long" else [(a, None if o is None else str(o), *s) for a, o, *s in rows]
        got = network.endpoint_states(_lines_of(named, kind)).collect()
        assert {(r.layer, None if r.owner is None else int(r.owner), str(r.x), str(r.y)): (r.n, r.state) for r in got} == want
    assert {s for _, s in want.values()} == {"connected", "near miss", "dangle"}


def test_dangles_of_a_query_are_not_broadcast(spark):
    from assay.plans import catalogue

    assert "Broadcast" not in _plan(catalogue.QUERIES["geo_dangles"](spark, "/root/testdata/sf0.001"))


def test_orphan_points_broadcast_no_rows_of_the_grid(spark):
    segments = _lines_of([("L", i, 0.0, float(i), 90.0, float(i)) for i in range(20)]).select("owner", "x1", "y1", "x2", "y2")
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 4.0), (3, 3.0, 4.5), (None, 3.0, 4.5), (4, None, 1.0), (5, float("nan"), 1.0)], "owner long, x double, y double")
    lone = network.orphan_points(points, segments)
    assert "Broadcast" not in _plan(lone)
    assert sorted((r.owner or 0) for r in lone.collect()) == [0, 3, 4, 5]


def test_segments_put_cells_down_only_near_ends_to_look_up(spark, monkeypatch):
    """What two owners' vertices connect needs no grid, and a lone end only the cells around it."""
    rows = [("L", o, float(k % 50), float(k), float(k % 50) + 60.0, float(k) + 40.0) for k in range(200) for o in (1, 2)]
    seen = []
    covered = network.covered
    monkeypatch.setattr(network, "covered", lambda *a: seen.append(covered(*a)) or seen[-1])
    for more, lone in (([], 0), ([("L", 3, 500.0, 500.0, 0.0, 0.0)], 1)):
        seen.clear()
        got = network.endpoint_states(_lines_of(rows + more)).collect()
        assert sum(r.n for r in got if r.state == "connected") == 2 * len(rows + more) - lone
        assert sum(f.count() for f in seen) < 200  # all segments cover about 10,000


def test_ends_that_are_no_vertices_nulls_and_points(spark):
    """An end need not be a vertex, of its own owner or another; a vertex of a point connects; null and NaN ends dangle."""
    nan, at = float("nan"), lambda *xy: list(xy)
    rows = [
        ("A", 1, 0.0, 0.0, 9.0, 0.0, at((0.0, 0.0), (4.0, 5.0))), ("A", 2, 0.0, 9.0, 9.0, 9.0, at((4.0, 5.0), (0.0, 0.0))), ("B", 2, 3.0, 7.0, 4.0, 7.0, at((None, 1.0), (nan, 1.0), (4.0, 5.0))),
        ("A", 3, 20.0, 0.0, 29.0, 0.0, at((20.0, 0.0), (29.0, 0.0))), ("A", 4, 24.0, 0.2, 24.0, 8.0, at((24.0, 0.2), (24.0, 8.0))), ("A", None, 40.0, 0.0, 49.0, 0.0, at((40.0, 0.0), (49.0, 0.0))), ("C", 5, 7.0, 7.0, 8.0, 7.0, None),
    ]
    frame = spark.createDataFrame(rows, "layer string, owner long, x1 double, y1 double, x2 double, y2 double, ends array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(9, 29.0, 0.0), (3, 20.0, 0.0), (None, 40.0, 0.0), (9, 49.0, 0.3), (9, None, 1.0)], "owner long, x double, y double")
    got = {(r.layer, r.owner, str(r.x), str(r.y)): (r.n, r.state) for r in network.endpoint_states(frame, points).collect()}
    assert got == {
        ("A", 1, "0.0", "0.0"): (1, "dangle"), ("A", 1, "4.0", "5.0"): (1, "dangle"), ("A", 2, "4.0", "5.0"): (1, "dangle"), ("A", 2, "0.0", "0.0"): (1, "connected"), ("B", 2, "None", "1.0"): (1, "dangle"),
        ("B", 2, "nan", "1.0"): (1, "dangle"), ("B", 2, "4.0", "5.0"): (1, "dangle"), ("A", 3, "20.0", "0.0"): (1, "dangle"), ("A", 3, "29.0", "0.0"): (1, "connected"), ("A", 4, "24.0", "0.2"): (1, "near miss"),
        ("A", 4, "24.0", "8.0"): (1, "dangle"), ("A", None, "40.0", "0.0"): (1, "dangle"), ("A", None, "49.0", "0.0"): (1, "near miss"),
    }


def test_dangles_of_a_query_leave_no_table_on_disk(spark):
    from assay.plans import catalogue

    spark.catalog.clearCache()
    assert sum(r.endpoints for r in catalogue.QUERIES["geo_dangles"](spark, "/root/testdata/sf0.001").collect()) > 0
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
