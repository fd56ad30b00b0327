"""XML documents: metadata evaluation, class and domain definitions, coordinate systems as WKT.

Definitions with a known layout are read by Spark's ``from_xml``.  Metadata come in
several standards with elements at any depth, so each document is searched by a
small function in an Arrow UDF; a DOCTYPE, no element at all or null count as no document.

XML that is not well formed is repaired: an end tag closes all that is open inside its
element, one without a start is dropped, what is open at the end is closed there, a
``<`` that begins no tag is text, as is an ``&`` that begins no known entity, attributes
without quotes or values are kept, and what follows the first element is left out.
"""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assay.functions.text import PLACEHOLDER

# Where the metadata standards keep each element, and its weight in the score.
PATHS = {
    "summary": ("idPurp", "purpose"),
    "description": ("idAbs", "abstract"),
    "tags": ("searchKeys/keyword", "themeKeys/keyword", "placeKeys/keyword", "themekey", "placekey", "keyword"),
    "credits": ("idCredit", "datacred", "credit"),
    "use_limits": ("useLimit", "othConsts", "useconst", "accconst", "useLimitation", "otherConstraints"),
    "contact": ("idPoC", "mdContact", "ptcontac", "pointOfContact", "contact"),
    "extent": ("GeoBndBox", "bounding", "EX_GeographicBoundingBox"),
    "lineage": ("dataLineage", "lineage", "LI_Lineage"),
}
WEIGHTS = {"summary": 1.0, "description": 1.5, "tags": 1.0, "credits": 0.75, "use_limits": 1.0, "contact": 1.0, "extent": 0.75, "lineage": 1.0}
ELEMENTS = tuple(PATHS)
EVALUATION = StructType([StructField(k, StringType()) for k in (*ELEMENTS, "standard")])

_HOLLOW = re.compile(PLACEHOLDER)


_NAME = r"[^\W\d][\w.:-]*"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|</\s*(?P<end>{_NAME})[^<>]*>|<(?P<start>{_NAME})(?P<rest>(?:[^<>"']|"[^"<]*"|'[^'<]*')*)>""", re.S)
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/]+)))?""")
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _recovered(doc: str) -> ElementTree.Element | None:
    """The first element of a document that is not well formed, with all that can be read of it; without namespaces."""
    local = lambda name: name.rpartition(":")[2]
    doc, out, open_, at, seen = _NOT_XML.sub("", doc), ElementTree.TreeBuilder(), [], 0, False
    for m in _TOKEN.finditer(doc):
        if open_:
            out.data(html.unescape(doc[at : m.start()]))
        at, end, start = m.end(), m["end"] and local(m["end"]), m["start"] and local(m["start"])
        if m["cdata"] and open_:
            out.data(m["cdata"])
        elif start:
            empty = m["rest"].rstrip().endswith("/")
            pairs = {local(k): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m["rest"]) if local(k) and not k.startswith("xmlns")}
            out.start(start, pairs)
            open_.append(start)
            if empty:
                out.end(open_.pop())
        elif end in open_:
            while out.end(open_.pop()).tag != end:
                pass
        if start and not open_ or end and seen and not open_:
            break
        seen = seen or bool(start)
    if open_:
        out.data(html.unescape(re.sub(r"<[^<>]*\Z", "", doc[at:])))
    for name in reversed(open_):
        out.end(name)
    try:
        return out.close()
    except AssertionError:  # no element at all
        return None


def _tree(doc: str | None) -> ElementTree.Element | None:
    if not doc or "<!DOCTYPE" in doc or "<!ENTITY" in doc:
        return None
    try:
        root = ElementTree.fromstring(doc.strip())
    except (ElementTree.ParseError, ValueError):
        root = _recovered(doc)
    if root is None:
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def _plain(e: ElementTree.Element) -> str:
    """The element's text as a reader sees it: markup that was stored as escaped text is unescaped and taken out."""
    return re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", html.unescape(" ".join(e.itertext())))).strip()


def _state(name: str, e: ElementTree.Element) -> str:
    if name == "extent":  # four bounds, however they are written
        return "present" if sum(1 for x in e.iter() if x.text and re.search(r"\d", x.text)) >= 4 else "missing"
    text = _plain(e)
    hollow = bool(_HOLLOW.search(text))
    if name == "contact":
        return "present" if len(text) >= 3 and not hollow else "missing"
    return "missing" if not text else "placeholder" if hollow else "present"


def evaluate(doc: str | None) -> dict:
    """The state of each element: present, placeholder, auto (lineage that a tool wrote) or missing; and the standard."""
    out: dict = dict.fromkeys(ELEMENTS, "missing") | {"standard": None}
    root = _tree(doc)
    if root is None:
        return out
    tags = {e.tag for e in root.iter() if isinstance(e.tag, str)}
    signs = {"ISO 19139": {"MD_Metadata"}, "FGDC CSDGM": {"idinfo"}, "ArcGIS": {"Esri", "dataIdInfo"}}
    out["standard"] = next((name for name, known in signs.items() if known & tags), "Unknown")
    machine = {child for e in root.iter("DataProperties") for child in e}
    for name, paths in PATHS.items():
        for e in (e for path in paths for e in root.iterfind(f".//{path}")):
            if name == "lineage" and e in machine:
                continue
            state = _state(name, e)
            if state != "missing":
                out[name] = state
            if state == "present":
                break
    if out["lineage"] == "missing" and any(e.find("DataProperties/lineage/Process") is not None for e in root.iterfind(".//Esri")):
        out["lineage"] = "auto"
    return out


@F.pandas_udf(EVALUATION)
def metadata(doc: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evaluate(d) for d in doc], columns=[*ELEMENTS, "standard"])


def metadata_score(found: Column, weights: dict[str, float] | None = None) -> Column:
    """0 to 100: present elements count whole, automatic ones half."""
    weights = weights or WEIGHTS
    gained = sum((F.when(found[k] == "present", w).when(found[k] == "auto", 0.5 * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.round(100.0 * gained / sum(weights.values()), 1)


_CLASS = """GPFieldInfoExs struct<GPFieldInfoEx:array<struct<Name:string,FieldType:string,IsNullable:string,Required:string,DomainName:string,AliasName:string>>>,
SubtypeFieldName string, Subtypes struct<Subtype:array<struct<SubtypeName:string,SubtypeCode:string,FieldInfos:struct<SubtypeFieldInfo:array<struct<FieldName:string,DomainName:string>>>>>>,
HasZ string, HasM string, ShapeType string, XYTolerance string"""
_DOMAIN = "DomainName string, FieldType string, Description string, CodedValues struct<CodedValue:array<struct<Name:string,Code:string>>>, MinValue string, MaxValue string"
_LENIENT = {"mode": "PERMISSIVE", "excludeAttribute": "true", "ignoreNamespace": "true"}


@F.pandas_udf(StringType())
def _repair(doc: pd.Series) -> pd.Series:
    trees = [_tree(d) for d in doc]
    return pd.Series([None if t is None else ElementTree.tostring(t, "unicode") for t in trees], dtype=object)


def repaired(xml: Column) -> Column:
    """XML as it is where Spark's parser reads it, else well-formed XML with what can be read, without namespaces; null if that is nothing.

    Only what the parser refuses travels to Python.  Add it as a column before a
    definition is read from it: Spark takes no Python function inside a definition.
    """
    broken = F.from_xml(xml, "_corrupt_record string", _LENIENT)["_corrupt_record"].isNotNull()
    return F.when(broken, _repair(F.when(broken, xml))).otherwise(xml)


def class_definition(xml: Column) -> Column:
    """struct(fields, subtype_field, subtypes, has_z, has_m, shape_type, xy_tolerance) of a class definition; null fields for broken XML (see ``repaired``)."""
    raw = F.from_xml(xml, _CLASS, _LENIENT)
    fields = F.transform(F.filter(raw["GPFieldInfoExs"]["GPFieldInfoEx"], lambda f: f["Name"].isNotNull()), lambda f: F.struct(
        f["Name"].alias("name"), F.coalesce(f["FieldType"], F.lit("")).alias("type"), (F.lower(F.coalesce(f["IsNullable"], F.lit("true"))) == "true").alias("nullable"),
        (F.lower(F.coalesce(f["Required"], F.lit("false"))) == "true").alias("required"), f["DomainName"].alias("domain"), f["AliasName"].alias("alias"),
    ))
    subtypes = F.transform(F.filter(raw["Subtypes"]["Subtype"], lambda s: s["SubtypeCode"].try_cast("int").isNotNull()), lambda s: F.struct(
        s["SubtypeCode"].try_cast("int").alias("code"), s["SubtypeName"].alias("name"),
        F.transform(F.filter(s["FieldInfos"]["SubtypeFieldInfo"], lambda i: i["FieldName"].isNotNull() & i["DomainName"].isNotNull()), lambda i: F.struct(F.lower(i["FieldName"]).alias("field"), i["DomainName"].alias("domain"))).alias("domains"),
    ))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return F.struct(
        none(fields, "array<struct<name:string,type:string,nullable:boolean,required:boolean,domain:string,alias:string>>").alias("fields"), raw["SubtypeFieldName"].alias("subtype_field"),
        none(subtypes, "array<struct<code:int,name:string,domains:array<struct<field:string,domain:string>>>>").alias("subtypes"),
        (F.lower(raw["HasZ"]) == "true").alias("has_z"), (F.lower(raw["HasM"]) == "true").alias("has_m"), raw["ShapeType"].alias("shape_type"), raw["XYTolerance"].try_cast("double").alias("xy_tolerance"),
    )


def domain_definition(xml: Column) -> Column:
    """struct(name, kind, field_type, description, codes, min, max); the name is null for broken XML (see ``repaired``)."""
    raw = F.from_xml(xml, _DOMAIN, _LENIENT)
    coded = xml.rlike(r"<(\w+:)?GPCodedValueDomain|<(\w+:)?CodedValues[ />]")
    whole, real = raw["FieldType"].rlike("Integer|OID"), raw["FieldType"].rlike("Double|Single")
    code = lambda c: F.when(c.try_cast("double").isNull(), c).when(whole, c.try_cast("double").cast("long").cast("string")).when(real, c.try_cast("double").cast("string")).otherwise(c)
    codes = F.transform(raw["CodedValues"]["CodedValue"], lambda v: F.struct(code(v["Code"]).alias("code"), F.coalesce(v["Name"], F.lit("")).alias("label")))
    return F.struct(
        raw["DomainName"].alias("name"), F.when(coded, "coded").otherwise("range").alias("kind"), raw["FieldType"].alias("field_type"), raw["Description"].alias("description"),
        F.coalesce(codes, F.array().cast("array<struct<code:string,label:string>>")).alias("codes"), F.when(~coded, raw["MinValue"].try_cast("double")).alias("min"), F.when(~coded, raw["MaxValue"].try_cast("double")).alias("max"),
    )


def crs(wkt: Column) -> Column:
    """struct(defined, name, horizontal, vertical, epsg, datum, unit, unit_m, geographic) of a WKT coordinate system, by its keywords.

    Null and blank texts are undefined; a text that is no WKT is defined, with its first 80 characters as its name.
    A geographic system's unit counts as 111,320 m.
    """
    some = F.coalesce(wkt, F.lit(""))

    def first(pattern: str) -> Column:
        got = F.regexp_extract(some, pattern, 1)
        return F.when(got != "", got)

    horizontal = first(r'(?i)(?:PROJCS|PROJCRS|GEOGCS|GEOGCRS|GEODCRS|BASEGEOGCRS)\[\s*"([^"]*)"')
    known = some.rlike(r'(?i)^\s*(COMPD_?CS|COMPOUNDCRS|PROJCS|PROJCRS|GEOGCS|GEOGCRS|GEODCRS|VERT_?CS|VERTCRS|BOUNDCRS|LOCAL_CS|ENGCRS)\[')
    projected = some.rlike(r"(?i)PROJ(CS|CRS)\[")
    defined = F.length(F.trim(some)) > 0
    # the projected system's own unit is the last one before its authority; a geographic system has degrees only
    flat = F.regexp_replace(some, r"(?is),?\s*(VERT_?CS|VERTCRS)\[.*$", "")
    units = F.regexp_extract_all(flat, F.lit(r'(?i)(?:LENGTH)?UNIT\[\s*"([^"]*)"\s*,\s*[0-9.eE+-]+'), F.lit(1))
    factors = F.regexp_extract_all(flat, F.lit(r'(?i)(?:LENGTH)?UNIT\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+)'), F.lit(1))
    codes = F.regexp_extract_all(flat, F.lit(r'(?i)(?:AUTHORITY\[\s*"EPSG"\s*,\s*"?|ID\[\s*"EPSG"\s*,\s*)(\d+)'), F.lit(1))
    return F.struct(
        defined.alias("defined"), F.when(defined, F.when(known, first(r'^\s*\w+\[\s*"([^"]*)"')).otherwise(F.substring(some, 1, 80))).alias("name"), horizontal.alias("horizontal"),
        first(r'(?i)(?:VERT_?CS|VERTCRS)\[\s*"([^"]*)"').alias("vertical"), F.try_element_at(codes, F.lit(-1)).try_cast("int").alias("epsg"), first(r'(?i)DATUM\[\s*"([^"]*)"').alias("datum"),
        F.when(projected, F.try_element_at(units, F.lit(-1))).when(horizontal.isNotNull(), "degree").alias("unit"),
        F.when(projected, F.try_element_at(factors, F.lit(-1)).try_cast("double")).when(horizontal.isNotNull(), 111320.0).alias("unit_m"), (horizontal.isNotNull() & ~projected).alias("geographic"),
    )
