"""XML that is not well formed keeps what can be read of it."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from assay.functions import documents


def _text(doc):
    got = documents._tree(doc)
    return None if got is None else ElementTree.tostring(got, "unicode")


@pytest.mark.parametrize(("doc", "expected"), [
    ("<a><b>x</a>", "<a><b>x</b></a>"), ("<a><b>x", "<a><b>x</b></a>"), ("<a></c>x</a>", "<a>x</a>"), ("<a>1 < 2 & 3</a>", "<a>1 &lt; 2 &amp; 3</a>"), ("<a k=1 m n='q'>x</a>", '<a k="1" m="" n="q">x</a>'),
    ("<a>x</a><b>y</b>", "<a>x</a>"), ("noise <a>x</a> noise", "<a>x</a>"), ("</z><a>&nbsp;&what;</a>", "<a>\xa0&amp;what;</a>"), ("<a>x<!-- <b> --><![CDATA[<c>]]><d/>", "<a>x&lt;c&gt;<d /></a>"),
    ("<g:a><h:b>x</g:a>", "<a><b>x</b></a>"), ("<a>x<b", "<a>x</a>"), ("<a>\x01x", "<a>x</a>"), ("<a/><b>", "<a />"), ("<broken", None), ("no xml", None), ("", None), (None, None), ("</a>", None), ("<!DOCTYPE a><a>", None),
])
def test_recovery(doc, expected):
    assert _text(doc) == expected


def test_a_document_cut_anywhere_keeps_the_elements_before_the_cut():
    rng = random.Random(4)
    for _ in range(200):
        words = [f"w{rng.randrange(1000)}" for _ in range(12)]
        whole = "<m>" + "".join(f"<p><q k='{w}'>{w}</q></p>" for w in words) + "</m>"
        cut = rng.randrange(3, len(whole))
        root = documents._tree(whole[:cut])
        done = words[: whole[:cut].count("</q>")]
        assert root.tag == "m" and [e.text for e in root.iter("q")][: len(done)] == done
    deep = documents._tree("<a>" * 20_000 + "x")
    assert sum(1 for _ in deep.iter()) == 20_000


def test_well_formed_documents_are_read_by_the_strict_parser():
    doc = '<?xml version="1.0"?><a xmlns:g="urn:g"><g:b k="1">x</g:b><!-- c --></a>'
    assert _text(doc) == '<a><b k="1">x</b></a>' and ElementTree.tostring(documents._recovered(doc), "unicode") == '<a><b k="1">x</b></a>'


def test_broken_definitions_and_metadata_keep_their_elements(spark):
    assert documents.evaluate("<metadata><dataIdInfo><idPurp>Purpose of it<idAbs>Water mains of the town")["summary"] == "present"
    coded = "<GPCodedValueDomain2><DomainName>Size</DomainName><FieldType>esriFieldTypeInteger</FieldType><CodedValues><CodedValue><Name>Gate & co</Name><Code>1</Code></CodedValue><CodedValue><Name>Ball</Name><Code>2"
    fields = "<DEFeatureClassInfo><GPFieldInfoExs><GPFieldInfoEx><Name>A</Name><IsNullable>false</IsNullable></GPFieldInfoEx><GPFieldInfoEx><Name>B</GPFieldInfoExs><HasZ>true</HasZ>"
    frame = spark.createDataFrame([(1, coded, fields), (2, "<broken", None), (3, None, "")], "id int, d string, c string")
    frame = frame.select("id", documents.repaired(F.col("d")).alias("d"), documents.repaired(F.col("c")).alias("c"))
    assert frame.where("id = 3").head() == (3, None, None) and frame.where("id = 2").head().d is None
    rows = {r.id: r for r in frame.select("id", documents.domain_definition(F.col("d")).alias("d"), documents.class_definition(F.col("c")).alias("c")).collect()}
    assert rows[1].d.name == "Size" and [(c.code, c.label) for c in rows[1].d.codes] == [("1", "Gate & co"), ("2", "Ball")]
    assert [(f.name, f.nullable) for f in rows[1].c.fields] == [("A", False), ("B", True)] and rows[1].c.has_z
    assert rows[2].d.name is None and rows[2].c.fields == [] and rows[3].d.name is None and rows[3].c.fields == []
