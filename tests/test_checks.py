"""The checks that work from catalog and geometry, each on planted defects; documents, manifests, replay."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assay.functions import geometry
from assay.plans import results, run
from assay.operators import trust
from assay.sources import dataset, sinks

UTM = 'PROJCS["NAD83 / UTM zone 16N",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],UNIT["metre",1],AUTHORITY["EPSG","26916"]]'
WGS = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
GOOD = "<metadata><dataIdInfo><idPurp>why</idPurp><idAbs>what</idAbs><searchKeys><keyword>k</keyword></searchKeys><idCredit>us</idCredit><useLimit>none known</useLimit><idPoC><n>desk</n></idPoC><GeoBndBox><a>1</a><b>2</b><c>3</c><d>4</d></GeoBndBox><dataLineage>made</dataLineage></dataIdInfo></metadata>"
AS_OF = datetime(2020, 1, 1)


def _shape(*parts):
    return [[[{"x": float(v[0]), "y": float(v[1]), "z": float(v[2]) if len(v) > 2 else None} for v in ring] for ring in part] for part in parts]


@pytest.fixture(scope="module")
def net(spark):
    far = 1000.0  # beyond degrees
    line = lambda *v: _shape([[(far + x, far + y, 0) for x, y in v]])
    rows = [
        (1, "{A}", 1, "Main", 1, "2001-01-01", line((0, 0), (10, 0))), (2, "B", 1, "main", 2, None, line((10, 0), (20, 0))), (3, "C", 1, "Mains", 2, None, line((20.2, 0), (30, 0))),
        (4, "D", 2, "Oddity", 1, None, line((5, 5), (5, 5))), (5, "A", 1, "Main", 1, None, None),
    ]
    kind = f"fid long, GLOBALID string, assetgroup int, assettype string, isconnected int, created_date string, geometry {geometry.SHAPE}"
    lines = spark.createDataFrame(rows, kind)
    valves = spark.createDataFrame([(1, "V1", _shape([[(far + 30, far, 5)]])), (2, "V2", _shape([[(far + 7, far + 3, 5)]])), (3, "V3", _shape([[(far + 7, far + 3, 5)]]))], f"fid long, GLOBALID string, geometry {geometry.SHAPE}")
    box = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    areas = spark.createDataFrame([(1, _shape([box(far, far, 4)], [box(far + 9, far, 4)])), (2, _shape([box(far, far, 2), box(far + 5, far + 5, 1)])), (3, _shape([[(far, far), (far + 1, far + 1), (far + 2, far + 2), (far, far)]]))], f"fid long, geometry {geometry.SHAPE}")
    cat = {
        "items": ([("db.Lines", "u1"), ("db.Other", "u9")], "name string, type string"), "types": ([("u1", "Feature Class")], "uuid string, label string"),
        "registered": ([("Lines", False, True), ("Gone", False, False), ("Packed", True, True)], "name string, has_cdf boolean, has_table boolean"),
        "definitions": ([("Lines", "Feature Class", GOOD, True, False, 0.01), ("Valves", "Feature Class", None, True, True, None), ("Areas", "Feature Class", "<metadata><Esri/><idPurp>TBD</idPurp></metadata>", False, False, None)], "class string, kind string, documentation string, has_z boolean, has_m boolean, xy_tolerance double"),
        "workspace": ([("<metadata><dataIdInfo><idPurp>why</idPurp></dataIdInfo></metadata>",)], "documentation string"),
        "crs": ([("Lines", UTM), ("Valves", UTM), ("Areas", WGS)], "layer string, wkt string"), "model_crs": ([("Lines model", WGS)], "model string, wkt string"),
        "references": ([("Lines", "assetgroup", "int", "Group"), ("Lines", "assettype", "string", "Nope")], "layer string, field string, type string, domain string"),
        "domains": ([("Group", "string"), ("Idle", "string")], "name string, field_type string"), "domain_codes": ([("Group", "1"), ("Group", "2")], "domain string, code string"),
        "models": ([("Lines model", "lines", "line", f, t, None, n, False) for f, t, n in (("globalid", "string", True), ("assetgroup", "string", True), ("assettype", "string", True), ("owner", "string", False), ("note", "string", True))] + [("Lines model", "Pumps", "point", "flow", "double", None, True, False)], "model string, class string, kind string, field string, type string, domain string, nullable boolean, required boolean"),
        "match_table": ([("field", "isconnected", "note", " exact_match"), ("field", "nowhere", "flow", "exact_match"), ("field", "fid", "ghost", "exact_match")], "type string, SubstringsA string, SubstringsB string, match_strings string"),
        "class_map": ([("Lines", "lines", 4), ("Lost", "lines", 1), ("Valves", "Nothing", 3)], "source_class string, target_class string, rows long"),
        "baseline": ([("Lines", "1", "Main"), ("Lines", "3", "Spare")], "class_name string, asset_group string, asset_type string"),
    }
    tables = {"Lines": lines, "Valves": valves, "Areas": areas}
    tables["UN_5_ASSOCIATIONS"] = spark.createDataFrame([(1, "a", "{b}", 2), (2, "a", "zz", 2), (3, "j1", "C", 3)], "fid long, FROMGLOBALID string, TOGLOBALID string, ASSOCIATIONTYPE int")
    tables["UN_5_SYSTEMJUNCTIONS"] = spark.createDataFrame([(1, "J1")], "fid long, GLOBALID string")
    tables["UN_5_SUBNETWORKS"] = spark.createDataFrame([(1, "1"), (2, "0")], "fid long, ISDIRTY string")
    tables["UN_5_DIRTYAREAS"] = spark.createDataFrame([(1,)], "fid long")
    tables["UN_5_LINEERRORS"] = spark.createDataFrame([(1,), (2,)], "fid long")
    catalog = {k: spark.createDataFrame(*v) for k, v in cat.items()}
    return dataset.Dataset(spark, "Lines", tables, catalog, geometry={"Lines": "line Z", "Valves": "point Z", "Areas": "polygon"})


@pytest.fixture(scope="module")
def result(net):
    run.load_plugins([str(Path(run.__file__).parents[2] / "plugins" / "short_lines.py")])
    got = run.validate(net, as_of=AS_OF)
    run._CHECKS.pop(("quality", "Very short lines"))
    return got


@pytest.fixture(scope="module")
def found(result):
    return {(r.check, r.layer, r.message): r for r in result.findings.collect()}


def test_no_check_fails(result, found):
    assert [m for m in found if m[2].startswith("Check failed")] == [] and result.status == "ok"
    assert {e["kind"] for e in result.events} >= {"job_start", "stage_start", "check_start", "finding", "log", "check_end", "stage_end", "job_end"}


@pytest.mark.parametrize("check, layer, message, severity", [
    ("Catalog", "Gone", "Gone is registered but missing: table file missing", "error"), ("Catalog", "Packed", "Packed is registered but missing: compressed", "info"),
    ("Match reference model", "", "Best reference model: Lines model", "info"),
    ("Layer coordinate systems", "Areas", "Areas declares WGS 84, but the dataset uses NAD83 / UTM zone 16N; its coordinates only fit the dominant system, so its own is wrong", "error"),
    ("Item metadata", "", "No metadata on 1 of 3 feature classes", "error"), ("Item metadata", "", "Summary holds template text on 1 items", "info"), ("Item metadata", "", "1 items carry only metadata that tools wrote", "warning"),
    ("CRS consistency", "", "Mixed horizontal systems: 2", "error"), ("CRS consistency", "", "2 layers store heights, but no vertical system is defined", "warning"),
    ("CRS and reference model", "", "The datum differs from the model's (North_American_Datum_1983 and WGS_1984): loading needs a transformation", "warning"),
    ("Provenance", "", "2 layers have no edit-tracking fields", "info"),
    ("Field mapping", "", "The match table has 1 rows with stray white space", "info"), ("Field mapping", "", "The match table maps to 1 fields that Lines model lacks", "warning"), ("Field mapping", "", "The match table names 1 source fields that the dataset lacks", "info"),
    ("Field mapping", "lost", "The mapping book lists lost, which the dataset lacks", "warning"), ("Field mapping", "lines", "The mapping book expects 4 rows of lines, the dataset has 5", "info"),
    ("Field mapping", "", "The mapping book targets 1 classes that Lines model lacks", "error"), ("Field mapping", "", "1 layers with data have no class mapping", "warning"),
    ("Domain integrity", "", "1 references point to domains that do not exist", "error"), ("Domain integrity", "", "1 fields use a domain of another type", "warning"), ("Domain integrity", "", "1 domains are not used by any field", "info"),
    ("Reference model", "Lines", "Lines lacks 1 required fields of Lines model/lines", "error"), ("Reference model", "Lines", "Lines lacks 1 fields of Lines model/lines", "warning"), ("Reference model", "Lines", "Lines has 1 fields of another type than Lines model/lines", "warning"),
    ("Reference model", "", "1 classes of the model are not in the dataset", "info"),
    ("Asset types", "Lines", "1 / Mains is close to 1 / Main", "info"), ("Asset types", "Lines", "1 asset types are not in the baseline", "warning"), ("Asset types", "Lines", "1 asset groups of the baseline are not used", "info"),
    ("Duplicate ids", "Areas", "Areas has no GlobalID field", "critical"), ("Duplicate ids", "Lines", "2 rows share a GlobalID", "critical"),
    ("Geometry validity", "Lines", "1 rows have null or empty geometry", "error"), ("Geometry validity", "Lines", "1 invalid shapes", "error"), ("Geometry validity", "Lines", "1 zero-length lines", "error"),
    ("Geometry validity", "Areas", "2 invalid shapes", "error"), ("Geometry validity", "Areas", "1 zero-area polygons", "error"), ("Geometry validity", "Valves", "2 points lie on another point of their class", "info"),
    ("Line connectivity", "Lines", "2 line ends stop short of another feature", "warning"), ("Line connectivity", "Lines", "3 line ends touch nothing", "info"), ("Orphan junctions", "Valves", "2 points are orphan junctions, on no line", "warning"),
    ("Z and M", "", "1 of 3 layers have no heights, others do", "warning"), ("Z and M", "", "2 layers have no measures, others do", "info"), ("Z and M", "", "1 layers with heights hold zeros only", "warning"),
    ("Connection status", "Lines", "2 rows are marked as not connected", "warning"),
    ("System tables", "UN_5_RULES", "The network has no rules", "error"), ("System tables", "UN_5_DIRTYAREAS", "1 dirty areas: the topology must be validated", "warning"), ("System tables", "", "2 topology errors are recorded", "error"),
    ("System tables", "UN_5_SUBNETWORKS", "1 of 2 subnetworks are dirty", "warning"), ("System tables", "UN_5_ASSOCIATIONS", "1 rows refer to features that do not exist", "error"),
])
def test_findings(found, check, layer, message, severity):
    assert (check, layer, message) in found, sorted(m for m in found if m[0] == check)
    assert found[check, layer, message].severity == severity


def test_scores_and_tables(result, found):
    assert all(v is not None for v in result.stages.values()) and result.grade in "ABCDF"
    tables = {k: v.collect() for k, v in result.tables.items()}
    assert {r["class"]: r.score for r in tables["metadata_items"]} == {"Lines": 100.0, "Valves": 0.0, "Areas": 0.0}
    assert {(r.layer, r.endpoints, r.near_miss, r.dangles) for r in tables["connectivity"]} == {("Lines", 8, 2, 3)}
    assert {r.layer: r.flat for r in tables["heights"]} == {"Lines": True, "Valves": False}
    assert {(r.name, r.kind) for r in tables["items"]} == {("db.Lines", "Feature Class"), ("db.Other", "u9")}
    shapes = [json.loads(r.feature) for r in tables["map"]]
    assert all(s["type"] == "Feature" and s["properties"]["layer"] in ("Lines", "Valves", "Areas") for s in shapes) and len(tables["top_issues"]) == 8
    assert sum(r.features for r in tables["legend"]) == len(shapes)
    fuzzy = found["Asset types", "Lines", "1 / Mains is close to 1 / Main"]
    assert 0.84 <= fuzzy.confidence < 1 and fuzzy.threshold == "0.84" and fuzzy.method.startswith("name similarity") and fuzzy.affected_count == 1


def test_report_has_its_columns(spark, result, tmp_path):
    out = trust.report(trust.dispose(result.findings, spark.createDataFrame([], "finding_id string, status string, note string")))
    assert len(out.columns) == 21 and out.columns[8] == "sample_object_ids"
    sinks.write_csv(out, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == out.columns and back.count() == out.count() and {r.disposition for r in back.collect()} == {"OPEN"}


def test_cancelled_and_failed_runs(spark, net):
    calls = iter([False, False, *[True] * 1000])
    got = run.validate(net, as_of=AS_OF, cancelled=lambda: next(calls))
    assert got.status == "cancelled" and got.events[-1]["kind"] == "job_end"
    broken = run.validate(dataset.Dataset(spark, "x", {}, errors={"t": "gone"}), as_of=AS_OF)
    assert (broken.status, broken.score, broken.grade) == ("failed", None, "n/a") and run.mean_score([broken]) is None


def test_documents_manifest_and_replay(spark, tmp_path):
    folder = tmp_path / "data"
    spark.createDataFrame([(1, "a"), (2, "a")], "fid long, GLOBALID string").coalesce(1).write.parquet(str(folder / "t.parquet"))
    go = lambda: results.document([run.validate(dataset.Dataset.open(spark, str(folder)), as_of=AS_OF)], generated=AS_OF)
    doc = go()
    assert doc["signature"] == go()["signature"] and doc["datasets"][0]["counts"]["critical"] == 1
    saved = results.manifest(spark, doc, {"data": str(folder)}, AS_OF)
    results.write(spark, saved, str(tmp_path / "manifest"))
    saved = results.read(spark, str(tmp_path / "manifest"))
    got = results.verify(spark, saved)
    assert got["match"] and got["differences"] == []
    spark.createDataFrame([(3, None)], "fid long, GLOBALID string").coalesce(1).write.mode("append").parquet(str(folder / "t.parquet"))
    got = results.verify(spark, saved)
    assert not got["match"] and "data: its files changed" in got["differences"] and "data: t has 3 rows, had 2" in got["differences"]
    assert not results.verify(spark, saved | {"rules": {"x": 1}})["match"]
    assert results.plain({"a": float("nan"), "b": AS_OF}) == {"a": None, "b": "2020-01-01 00:00:00"}


def test_hashes_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(b"one")
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"twotwo")
    rows = {r.file: r for r in sinks.input_hashes(spark, str(tmp_path / "in")).collect()}
    assert rows["a.bin"].sha256 == hashlib.sha256(b"one").hexdigest() and rows["sub/b.bin"]["size"] == 6
    big = {r.file: r.sha256 for r in sinks.input_hashes(spark, str(tmp_path / "in"), whole=4).collect()}
    assert big["a.bin"] == rows["a.bin"].sha256 and big["sub/b.bin"] != rows["sub/b.bin"].sha256
    one = sinks.input_hash(sinks.input_hashes(spark, str(tmp_path / "in"))).head()
    assert (one.files, one.bytes) == (2, 9)




def _all(store):
    seen = store.executionsList()
    return [seen.apply(i) for i in range(seen.size())]


def test_distance_join_runs_once_whatever_is_found(spark):
    """The number of queries that the connectivity check runs does not grow with the layers' findings."""
    from assay.plans import checks

    line = lambda *v: _shape([v])

    store = spark._jsparkSession.sharedState().statusStore()

    def executions(n):
        kind = f"fid long, geometry {geometry.SHAPE}"
        layers = {f"Line{k}": spark.createDataFrame([(1, line((0.0, 10.0 * k), (10.0, 10.0 * k))), (2, line((10.2, 10.0 * k), (20.0, 10.0 * k)))], kind) for k in range(n)}
        r = run.Run(dataset.Dataset(spark, "d", layers, geometry=dict.fromkeys(layers, "line")), as_of=AS_OF)
        r.now = next(c for c in run._CHECKS.values() if c.fn is checks.connectivity)
        r.layers(), checks.systems(r)
        before = max((e.executionId() for e in _all(store)), default=-1)
        checks.connectivity(r)
        assert sorted((f[4], f[6], f[7]) for f in r.findings) == sorted(x for k in range(n) for x in ((f"Line{k}", 2, "1,2"), (f"Line{k}", 2, "1,2")))
        return sum(e.executionId() > before for e in _all(store))

    assert executions(1) == executions(4) > 1


@pytest.mark.parametrize(("kind", "expected"), [("esriFieldTypeInteger", ["1", "2", "x", None]), ("esriFieldTypeDouble", ["1.0", "2.5", "x", None]), ("esriFieldTypeSingle", ["1.0", "2.5", "x", None]), ("esriFieldTypeString", ["1", "2.5", "x", None])])
def test_codes_take_the_kind_of_their_field(spark, kind, expected):
    from assay.functions import documents

    codes = "".join(f"<CodedValue><Code>{c}</Code><Name>n</Name></CodedValue>" for c in ("1", "2.5", "x")) + "<CodedValue><Name>n</Name></CodedValue>"
    xml = f"<GPCodedValueDomain2><DomainName>D</DomainName><FieldType>{kind}</FieldType><CodedValues>{codes}</CodedValues></GPCodedValueDomain2>"
    got = spark.createDataFrame([(xml,)], "x string").select(documents.domain_definition(F.col("x")).alias("d")).head().d
    assert [c.code for c in got.codes] == expected
