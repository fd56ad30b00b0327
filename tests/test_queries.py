"""Every registered query against its SQL in DuckDB, and those without SQL against what they must give."""

import os

import duckdb
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from assay.functions import documents
from assay.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con: duckdb.DuckDBPyConnection, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(SQL) == {"asset_fuzzy", "geo_geojson", "input_hash"}
    assert all(0.84 <= r.confidence <= 1 for r in QUERIES["asset_fuzzy"](spark, SF).collect())
    assert QUERIES["input_hash"](spark, SF).collect()[0].files == 14
    assert all(r.feature.startswith('{"type":"Feature","geometry":{"type":"LineString"') for r in QUERIES["geo_geojson"](spark, SF).limit(5).collect())


# definitions and systems as files have them
WKT = [(1, 'COMPD_CS["UTM + height",PROJCS["NAD83 / UTM zone 16N",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],UNIT["metre",1],AUTHORITY["EPSG","26916"]],VERT_CS["NAVD88 height",VERT_DATUM["NAVD88",2005],UNIT["metre",1]]]'), (2, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'), (3, 'PROJCS["State plane",GEOGCS["NAD83",DATUM["NAD83",SPHEROID["x",1,2]],UNIT["degree",0.01745]],UNIT["US survey foot",0.3048006096012192]]'), (4, "not a system"), (5, ""), (6, None)]
CLASS_XML = """<DEFeatureClassInfo xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="typens:DEFeatureClassInfo"><HasZ>true</HasZ><HasM>false</HasM><ShapeType>Line</ShapeType><XYTolerance>0.001</XYTolerance><SubtypeFieldName>ASSETGROUP</SubtypeFieldName><GPFieldInfoExs xsi:type="x"><GPFieldInfoEx xsi:type="x"><Name>ASSETGROUP</Name><FieldType>esriFieldTypeInteger</FieldType><IsNullable>false</IsNullable></GPFieldInfoEx><GPFieldInfoEx xsi:type="x"><Name>SIZE</Name><FieldType>esriFieldTypeDouble</FieldType><DomainName>Size</DomainName></GPFieldInfoEx></GPFieldInfoExs><Subtypes><Subtype><SubtypeName>Main</SubtypeName><SubtypeCode>1</SubtypeCode><FieldInfos><SubtypeFieldInfo><FieldName>ASSETTYPE</FieldName><DomainName>Main types</DomainName></SubtypeFieldInfo></FieldInfos></Subtype><Subtype><SubtypeName>Bad</SubtypeName><SubtypeCode>x</SubtypeCode></Subtype></Subtypes></DEFeatureClassInfo>"""
DOMAIN_XML = [("<GPCodedValueDomain2 xmlns:xs='x'><DomainName>Size</DomainName><FieldType>esriFieldTypeSmallInteger</FieldType><CodedValues><CodedValue><Name>Gate</Name><Code xs:type='xs:short'>1</Code></CodedValue><CodedValue><Name>Ball</Name><Code>2.0</Code></CodedValue></CodedValues></GPCodedValueDomain2>",), ("<GPRangeDomain2><DomainName>Depth</DomainName><FieldType>esriFieldTypeDouble</FieldType><MinValue>0</MinValue><MaxValue>150.5</MaxValue></GPRangeDomain2>",), ("<broken",)]


def test_definitions_and_systems_as_files_have_them(spark):
    crs = {r.id: r.c for r in spark.createDataFrame(WKT, "id int, wkt string").select("id", documents.crs(F.col("wkt")).alias("c")).collect()}
    assert (crs[1].horizontal, crs[1].vertical, crs[1].epsg, crs[1].unit, crs[1].geographic) == ("NAD83 / UTM zone 16N", "NAVD88 height", 26916, "metre", False)
    assert crs[2].geographic and crs[2].unit_m == 111320.0 and crs[3].unit_m == 0.3048006096012192
    assert crs[4].defined and crs[4].name == "not a system" and not crs[5].defined and not crs[6].defined
    codes = {r.d.name: r.d for r in spark.createDataFrame(DOMAIN_XML, "xml string").select(documents.domain_definition(F.col("xml")).alias("d")).collect()}
    assert [(c.code, c.label) for c in codes["Size"].codes] == [("1", "Gate"), ("2", "Ball")] and (codes["Depth"].min, codes["Depth"].max) == (0.0, 150.5) and None in codes
    classes = [r.c for r in spark.createDataFrame([(CLASS_XML,), ("<broken",)], "xml string").select(documents.class_definition(F.col("xml")).alias("c")).collect()]
    assert [len(c.fields) for c in classes] == [2, 0] and [[(x.code, x.name) for x in c.subtypes] for c in classes] == [[(1, "Main")], []]
