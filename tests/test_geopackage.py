"""A GeoPackage written with SQLite, read by Spark: rows, types, partitions, catalog, and a validation run over it."""

import datetime as dt
import sqlite3
import struct

import pytest

from assay.plans import run
from assay.sources import geopackage

WKT = 'PROJCS["NAD83 / UTM zone 16N",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["central_meridian",-87],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],UNIT["metre",1]]'


def point(x, y, envelope=0, order=1):
    extra = struct.pack("<4d", x, x, y, y) if envelope == 1 else b""
    return b"GP" + bytes([0, 1 | envelope << 1]) + struct.pack("<i", 26916) + extra + struct.pack("<BI2d", order, 1, x, y)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("gpkg") / "town's net.gpkg"
    con = sqlite3.connect(p)
    con.executescript("""
        create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text);
        create table gpkg_contents (table_name text primary key, data_type text, identifier text);
        create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);
        create table gpkg_metadata (id integer primary key, md_scope text, metadata text);
        create table gpkg_metadata_reference (reference_scope text, table_name text, column_name text, row_id_value integer, timestamp datetime, md_file_id integer, md_parent_id integer);
        create table "Valve" (fid integer primary key, geom POINT, "GLOBALID" text(38), size mediumint, rate double, open boolean, built date, seen datetime, raw blob, "odd ""name" text);
        create table "Notes" (id integer primary key, body text);
        create table plain (k text primary key, v integer) without rowid;
        create table bare (id integer primary key, v text);
        create view big as select fid, size from Valve where size > 5;
        create table rtree_Valve_geom (id integer);
    """)
    con.execute("insert into gpkg_spatial_ref_sys values ('utm', 26916, 'EPSG', 26916, ?), ('none', -1, 'NONE', -1, 'undefined')", (WKT,))
    con.execute("insert into gpkg_geometry_columns values ('Valve', 'geom', 'POINT', 26916, 0, 0)")
    con.executemany("insert into gpkg_metadata values (?, 'dataset', ?)", [(1, "<m>old</m>"), (2, "<m>new</m>"), (3, "<m>whole</m>"), (4, "<m>none</m>")])
    con.executemany("insert into gpkg_metadata_reference values (?, ?, null, null, ?, ?, null)", [("table", "VALVE", "2020-01-01T00:00:00Z", 1), ("table", "valve", "2021-01-01T00:00:00Z", 2), ("geopackage", None, "2020-01-01T00:00:00Z", 3), ("row", None, "2020-01-01T00:00:00Z", 4), ("table", "Notes", "2020-01-01T00:00:00Z", 99)])
    for i in range(1, 26):
        con.execute("insert into Valve values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", (i * 1000, point(500000 + i, 4630000, i % 2), "{A}" if i < 3 else f"g{i}", i, i / 4, i % 2, f"2001-02-{i:02d}", f"2001-02-{i:02d}T03:04:05.250Z", bytes([i]), f"n{i}"))
    con.execute("insert into Valve values (99000, X'0102', null, 'many', 'fast', 'maybe', 'soon', 'later', 7, X'00')")
    con.execute("insert into Valve (fid) values (99001)")
    con.executemany("insert into plain values (?, ?)", [("a", 1), ("b", 2)])
    con.execute("insert into Notes values (1, 'é')")
    con.commit()
    con.close()
    return str(p)


@pytest.mark.parametrize("rows", [1, 7000, 10**9])
def test_rows_types_and_partitions(spark, path, rows):
    df = geopackage.read(spark, path, "Valve", rows=rows if rows > 1 else 3000)
    got = {r.fid: r for r in df.collect()}
    assert len(got) == 27 and df.rdd.getNumPartitions() == len(range(1000, 99002, rows if rows > 1 else 3000))
    r = got[5000]
    assert (r.GLOBALID, r["size"], r.rate, r.open, r.built, r.raw, r['odd "name']) == ("g5", 5, 1.25, True, dt.date(2001, 2, 5), bytearray([5]), "n5")
    assert r.seen.isoformat() == "2001-02-05T03:04:05.250000" and bytes(r.geom) == struct.pack("<BI2d", 1, 1, 500005, 4630000) == bytes(r.geom)
    bad = got[99000]
    assert all(bad[c] is None for c in ("geom", "size", "rate", "open", "built", "seen", "raw", 'odd "name')) and all(v is None for k, v in got[99001].asDict().items() if k != "fid")


def test_columns_views_and_tables_without_row_ids(spark, path):
    assert geopackage.read(spark, path, "Valve", columns="size, fid").columns == ["size", "fid"]
    assert geopackage.read(spark, path, "big").count() == 21 and geopackage.read(spark, path, "bare").collect() == []
    assert sorted(tuple(r) for r in geopackage.read(spark, path, "plain").collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="no table"):
        geopackage.read(spark, path, "Gone").schema


def test_dataset_and_catalog(spark, path):
    data = geopackage.open_dataset(spark, path)
    assert data.name == "town's net" and set(data.frames) == {"Valve", "Notes", "plain", "bare", "big"} and data.geometry == {"Valve": "point"} and not data.errors
    facts = {r["class"]: r for r in data.catalog["definitions"].collect()}
    assert facts["Valve"].documentation == "<m>new</m>" and facts["Notes"].documentation is None and facts["Valve"].has_z is False and facts["plain"].has_z is None
    assert [r.documentation for r in data.catalog["workspace"].collect()] == ["<m>whole</m>"]
    assert [(r.layer, r.wkt) for r in data.catalog["crs"].collect()] == [("Valve", WKT)]
    assert {(r.name, r.type) for r in data.catalog["items"].collect()} == {("Valve", "Feature Class"), *((t, "Table") for t in ("Notes", "plain", "bare", "big"))}


def test_a_run_over_a_geopackage(spark, path):
    result = run.validate(geopackage.open_dataset(spark, path), as_of=dt.datetime(2002, 1, 1))
    found = {(r.check, r.layer, r.message) for r in result.findings.collect()}
    assert ("Duplicate ids", "Valve", "2 rows share a GlobalID") in found and ("Required fields", "Valve", "2 of 27 values in GLOBALID are blank") in found
    assert ("Geometry validity", "Valve", "2 rows have null or empty geometry") in found and ("Inventory", "bare", "bare is empty") in found
    assert not [f for f in found if "failed to run" in f[2]]
    assert "26916" not in str(found) and '"coordinates":[-86.99' in result.tables["map"].head().feature
