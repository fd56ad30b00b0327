"""Projections against published control points, round trips, and layers of two systems connected in one run."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assay.functions import geometry, projection
from assay.plans import run
from assay.sources import dataset

DEGREE, FOOT = "0.0174532925199432957692", "0.304800609601219241"


def wkt(globe, method, unit, **parameters):
    named = ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters.items())
    return f'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["s",{globe}]],PRIMEM["Greenwich",0],UNIT["degree",{DEGREE}]],PROJECTION["{method}"],{named},UNIT["u",{unit}],AUTHORITY["EPSG","1"]]'


GRID = wkt("6377563.396,299.32496", "Transverse_Mercator", 1, latitude_of_origin=49, central_meridian=-2, scale_factor=0.9996012717, false_easting=400000, false_northing=-100000)
TEXAS = wkt("6378206.4,294.978698213898", "Lambert_Conformal_Conic_2SP", FOOT, standard_parallel_1=28.3833333333333, standard_parallel_2=30.2833333333333, latitude_of_origin=27.8333333333333, central_meridian=-99, false_easting=2000000, false_northing=0)
JAMAICA = wkt("6378206.4,294.978698213898", "Lambert_Conformal_Conic_1SP", 1, latitude_of_origin=18, central_meridian=-77, scale_factor=1, false_easting=250000, false_northing=150000)
UTM = wkt("6378137,298.257222101", "Transverse_Mercator", 1, latitude_of_origin=0, central_meridian=-87, scale_factor=0.9996, false_easting=500000, false_northing=0)
SOUTH = wkt("6378137,298.257222101", "Lambert_Conformal_Conic", 1, Standard_Parallel_1=-36, Standard_Parallel_2=-38, Latitude_Of_Origin=-37, Central_Meridian=145, False_Easting=2500000, False_Northing=2500000)
WEB = wkt("6378137,298.257223563", "Mercator_Auxiliary_Sphere", 1, Central_Meridian=0)
WGS = f'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",{DEGREE}],AUTHORITY["EPSG","4326"]]'
UTM2 = 'PROJCRS["x",BASEGEOGCRS["g",DATUM["d",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["UTM zone 16N",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",8801]],PARAMETER["Longitude of natural origin",-87,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["e",east],LENGTHUNIT["metre",1]]'


def _at(spark, system, lon, lat):
    """The point in the system, and back from there."""
    p = projection.parse(system)
    out = spark.range(1).select(projection.between(projection.DEGREES, p)(F.lit(lon), F.lit(lat)).alias("p"))
    r = out.select("p", projection.between(p, projection.DEGREES)(F.col("p.x"), F.col("p.y")).alias("b")).head()
    return r.p.x, r.p.y, r.b.x, r.b.y


# Worked examples of the public guidance note on coordinate conversions (EPSG 373-7-2), and the scale at the central meridian.
@pytest.mark.parametrize(("system", "lon", "lat", "x", "y", "within"), [
    (GRID, 0.5, 50.5, 577274.99, 69740.50, 0.01), (TEXAS, -96.0, 28.5, 2963503.91, 254759.80, 0.01),
    (JAMAICA, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 255966.58, 142493.51, 0.01),
    (WEB, -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00, 0.01), (UTM, -87.0, 0.0, 500000.0, 0.0, 1e-6),
])
def test_control_points(spark, system, lon, lat, x, y, within):
    a, b, back_lon, back_lat = _at(spark, system, lon, lat)
    assert abs(a - x) < within and abs(b - y) < within
    assert abs(back_lon - lon) < 1e-9 and abs(back_lat - lat) < 1e-9


def test_meridian_arc_by_quadrature(spark):
    p = projection.parse(UTM)
    steps = 20_000
    lat = math.radians(47.25)
    m = lambda t: p.a * (1 - p.e**2) / (1 - (p.e * math.sin(t)) ** 2) ** 1.5
    arc = sum(m(lat * (i + 0.5) / steps) for i in range(steps)) * lat / steps
    assert abs(_at(spark, UTM, -87.0, 47.25)[1] - 0.9996 * arc) < 1e-3


@pytest.mark.parametrize("system", [GRID, TEXAS, JAMAICA, UTM, SOUTH, WEB])
def test_round_trips_to_a_tenth_of_a_millimetre(spark, system):
    p = projection.parse(system)
    lon0, lat0 = math.degrees(p.lon0), math.degrees(p.lat0)
    points = spark.range(441).select((lon0 + (F.col("id") % 21 - 10) * 0.6).alias("lon"), (lat0 + (F.floor(F.col("id") / 21) - 10) * 0.7).alias("lat"))
    there = points.select("*", projection.between(projection.DEGREES, p)(F.col("lon"), F.col("lat")).alias("p"))
    r = there.select(F.greatest(F.abs(projection.between(p, projection.DEGREES)(F.col("p.x"), F.col("p.y")).x - F.col("lon")), F.abs(projection.between(p, projection.DEGREES)(F.col("p.x"), F.col("p.y")).y - F.col("lat"))).alias("off")).agg(F.max("off").alias("off"), F.count("*").alias("n")).head()
    assert r.n == 441 and r.off < 1e-9


def test_dialects_and_what_cannot_be_read():
    two, one = (vars(projection.parse(w)) for w in (UTM2, UTM))
    assert two.pop("method") == one.pop("method") == "tm" and {k: v for k, v in two.items() if v is not None} == pytest.approx({k: v for k, v in one.items() if v is not None}, rel=1e-12)
    assert projection.parse(WGS).method == "" and projection.parse(f'COMPD_CS["c",{UTM},VERT_CS["v",VERT_DATUM["d",2005],UNIT["foot",0.3048]]]').unit == 1.0
    assert projection.parse(None) is None and projection.parse("") is None and projection.parse("not a system") is None
    assert projection.parse(wkt("6378137,298.257223563", "Oblique_Stereographic", 1)) is None
    assert projection.parse(wkt("6371000,0", "Mercator", 1)).f == 0.0


def test_heights_and_empty_shapes_stay(spark):
    change = projection.between(projection.DEGREES, projection.parse(UTM))
    rows = [(1, [[[{"x": -87.0, "y": 0.0, "z": 7.0}]]]), (2, []), (3, None)]
    got = {r.id: r.g for r in spark.createDataFrame(rows, f"id int, g {geometry.SHAPE}").select("id", geometry.moved(F.col("g"), change).alias("g")).collect()}
    v = got[1][0][0][0]
    assert (round(v.x, 6), round(v.y, 6), v.z) == (500000.0, 0.0, 7.0) and got[2] == [] and got[3] is None


@pytest.mark.parametrize("valves", [WGS, SOUTH, TEXAS])
def test_layers_of_two_systems_are_connected(spark, valves):
    """Lines in metres, end points in another system: the ends meet only after projection."""
    ends = [(500000.0, 4630000.0), (500100.0, 4630000.0)]
    shape = lambda *v: [[[{"x": x, "y": y, "z": None} for x, y in v]]]
    lines = spark.createDataFrame([(1, shape(*ends))], f"fid long, geometry {geometry.SHAPE}")
    change = projection.between(projection.parse(UTM), projection.parse(valves))
    points = spark.createDataFrame([(i, shape(p)) for i, p in enumerate(ends)], f"fid long, geometry {geometry.SHAPE}").withColumn("geometry", geometry.moved(F.col("geometry"), change))
    crs = spark.createDataFrame([("Line", UTM), ("Valve", valves.replace('PROJCS["x"', 'PROJCS["other"'))], "layer string, wkt string")
    data = dataset.Dataset(spark, "mixed", {"Line": lines, "Valve": points}, {"crs": crs}, geometry={"Line": "line", "Valve": "point"})
    result = run.validate(data, as_of=datetime(2020, 1, 1), stages=("quality",))
    r = {x.layer: x for x in result.tables["connectivity"].collect()}["Line"]
    assert (r.endpoints, r.near_miss, r.dangles) == (2, 0, 0)
    assert not [f for f in result.findings.collect() if "failed to run" in f.message]
