"""Further queries: conformance, mapping, metadata, assets, profiles, geometry, scores and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import documents, geometry, projection, scoring, text
from assay.operators import assets, conformance, lineage, mapping, network, profiles, trust
from assay.plans.queries import _BLANK, _FAMILY, _NULLS, domain_coded_text, dup_within_class, inline, num, planted, query, read, required_nulls_severity, values
from assay.plans.queries import _LI, _TEXT
from assay.plans import run
from assay.sources import dataset, geopackage, sinks
from assay.streaming import events

# ---- conformance ----------------------------------------------------------------------------------

_S, _M, _P, _MO = "p_source s", "p_model m", "p_pairs p", "p_models m"
_TRACK = "('created_user', 'creator')"
_FIELDS = f"""with a as (select s.class as class, lower(field) as field, type, domain from {_S} join {_P} on p.class = s.class where not regexp_matches(type, 'OID|Geometry|Blob|Raster|XML', 'i')),
b as (select p.class as class, lower(field) as field, type, domain, nullable, required from {_M} join {_P} on p.counterpart = m.class where not regexp_matches(type, 'OID|Geometry|Blob|Raster|XML', 'i')),
j as (select coalesce(a.class, b.class) as class, coalesce(a.field, b.field) as field, a.field is not null as here, b.field is not null as there, {_FAMILY.format("coalesce(a.type, '?')")} as fa, {_FAMILY.format("coalesce(b.type, '?')")} as fb, a.domain as da, b.domain as db, coalesce(not b.nullable or b.required or b.field in ('assetgroup', 'assettype'), false) as needed from a full join b on a.class = b.class and a.field = b.field)
select class, field, case when not here and field in {_TRACK} and class in (select class from a where field in {_TRACK}) then 'ok' when not here and needed and field not in {_TRACK} then 'missing required' when not here then 'missing'
when not there and field in {_TRACK} and class in (select class from b where field in {_TRACK}) then 'ok' when not there then 'extra' when fa <> fb then 'type' when db is not null and lower(coalesce(da, '')) <> lower(db) then 'domain' else 'ok' end as status, there from j"""


@query(_FIELDS)
def conformance_fields(spark, sf):
    return conformance.field_conformance(*[planted(spark, sf, t) for t in ("p_source", "p_model", "p_pairs")])


@query(f"select distinct class from {_M} where class not in (select counterpart from {_P})")
def conformance_absent(spark, sf):
    return planted(spark, sf, "p_model").select("class").distinct().join(planted(spark, sf, "p_pairs").select(F.col("counterpart").alias("class")), "class", "left_anti")


@query(f"select class, count(*) filter (there) as fields, count(*) filter (starts_with(status, 'missing')) as missing, count(*) filter (status = 'type') as mismatched, 100.0::double * (count(*) filter (there) - count(*) filter (starts_with(status, 'missing')) - count(*) filter (status = 'type')) / count(*) filter (there) as score from ({_FIELDS}) group by class")
def conformance_score(spark, sf):
    return conformance.conformance_scores(conformance_fields(spark, sf))


@query(f"""with a as (select class, any_value(kind) as kind, list(lower(field)) as f from {_S} group by 1), b as (select class as counterpart, any_value(kind) as kind, list(lower(field)) as f from {_M} group by 1),
j as (select class, counterpart, case when lower(class) = lower(counterpart) then 1.0::double else len(list_intersect(a.f, b.f))::double / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) end as similarity, lower(class) <> lower(counterpart) as other from a, b where lower(class) = lower(counterpart) or a.kind = b.kind)
select class, counterpart, similarity from (select *, row_number() over (partition by class order by other, similarity desc, counterpart) as r from j where not other or similarity >= 0.5) where r = 1""")
def best_counterpart(spark, sf):
    return conformance.counterparts(planted(spark, sf, "p_source"), planted(spark, sf, "p_model"))




@query(f"""with s as (select count(distinct lower(class)) as c, count(distinct lower(field)) as f from {_S}), m as (select distinct model from {_MO} where model <> 'my water'),
c as (select model, count(distinct class) as m, count(distinct class) filter (class in (select lower(class) from {_S})) as k from {_MO} group by 1), f as (select model, count(distinct field) as m, count(distinct field) filter (field in (select lower(field) from {_S})) as k from {_MO} group by 1),
x as (select m.model, round(3 * (c.k::double / (c.m + s.c - c.k)) + f.k::double / (f.m + s.f - f.k) + case when m.model like '%water%' then 0.5 else 0.0 end + case when m.model like '%essential%' then 0.15 else 0.0 end, 3) as score from m join c using (model) join f using (model), s)
select model, score, cast(row_number() over (order by score desc, model) as int) as rank from x qualify rank <= 5""")
def match_target(spark, sf):
    return conformance.match_models(planted(spark, sf, "p_source"), planted(spark, sf, "p_models"), "my water", "data/essential")


# ---- mapping --------------------------------------------------------------------------------------

MATCH = [("field", "c_name", "FullName", "exact_match"), ("Field", " c_custkey ", "custid", "exact_match "), ("field", "gone", "nowhere", "exact_match"), ("value", "o_orderkey", "orderid", "exact_match"), ("field", "o_orderstatus", "status", "exact_block"), ("field", "p_brand", "brand", "exact_match")]
TARGETS = [("person", "custid"), ("person", "fullname"), ("person", "c_nationkey"), ("sale", "o_custkey"), ("sale", "status"), ("thing", "brand"), ("thing", "p_size")]
CLASS_MAP = [("customer", "person"), ("orders", "sale")]
_MATCH, _TG, _CM = values(MATCH, "m(type, a, b, how)"), values(TARGETS, "t(class, field)"), values(CLASS_MAP, "c(layer, class)")
_ALIAS = f"select lower(trim(a)) as source, lower(trim(b)) as target from {_MATCH} where lower(trim(type)) = 'field' and trim(how) = 'exact_match'"
_USED = ("customer", "orders", "part")


def _match(spark):
    return inline(spark, "type string, SubstringsA string, SubstringsB string, match_strings string", MATCH)


def _fields(spark, sf):
    return dataset.Dataset.open(spark, sf, _USED).fields()


_FLD = " union all ".join(f"select '{t}' as layer, lower(column_name) as field from (describe {t})" for t in _USED)


@query(f"""with f as ({_FLD}), al as ({_ALIAS}), allowed as (select layer, field from {_CM} join {_TG} using (class) union select l.layer, t.field from (select distinct layer from f where layer not in (select layer from {_CM})) l, {_TG}),
m as (select layer, field, exists (select 1 from allowed x where x.layer = f.layer and (x.field = f.field or x.field in (select target from al where source = f.field))) as mapped from f)
select layer, count(*) as fields, count(*) filter (mapped) as mapped, round(100.0::double * count(*) filter (mapped) / count(*), 1) as coverage from m group by 1""")
def mapping_coverage(spark, sf):
    return mapping.coverage(_fields(spark, sf), inline(spark, "class string, field string", TARGETS), mapping.aliases(_match(spark)), inline(spark, "layer string, class string", CLASS_MAP))


@query(f"with f as ({_FLD}), al as ({_ALIAS}) select distinct 'source' as side, source as name from al where source not in (select field from f) union all select distinct 'target', target from al where target not in (select field from {_TG})")
def mapping_bad_fields(spark, sf):
    return mapping.unknown_names(mapping.aliases(_match(spark)), _fields(spark, sf), inline(spark, "class string, field string", TARGETS))


BOOK = [("Customer", "person", 1000), ("customer", "person", 500), ("orders", "sale", 1), ("lost", "thing", 3)]


@query(f"""select lower(source) as class, sum(n)::bigint as expected, any_value(have) as actual, case when any_value(have) is null then 'missing' when any_value(have) <> sum(n) then 'differs' else 'ok' end as status
from {values(BOOK, 'b(source, target, n)')} left join (select 'customer' as layer, count(*) as have from customer union all select 'orders', count(*) from orders union all select 'part', count(*) from part) on layer = lower(source) group by 1""")
def mapping_rowcount(spark, sf):
    return mapping.row_counts(inline(spark, "source_class string, target_class string, rows long", BOOK), dataset.Dataset.open(spark, sf, _USED).layers())


@query(f"select a, b from {_MATCH} where type <> trim(type) or a <> trim(a) or b <> trim(b) or how <> trim(how)")
def mapping_whitespace(spark, sf):
    return mapping.stray_space(_match(spark)).select(F.col("SubstringsA").alias("a"), F.col("SubstringsB").alias("b"))


# ---- metadata -------------------------------------------------------------------------------------

_PURPOSE = "case when doc_id % 5 = 0 then 'TBD' when doc_id % 7 = 0 then '' else concat('about ', source) end"
_EMPTY_HTML = "&amp;lt;p&amp;gt; &amp;lt;/p&amp;gt;"  # markup escaped twice: no text at all
_ABSTRACT = f"case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then 'REQUIRED: a summary' when doc_id % 6 = 2 then '{_EMPTY_HTML}' else concat('made of ', lang) end"
_CONTACT = "case when doc_id % 4 = 0 then 'TBD' when doc_id % 4 = 1 then 'x' when doc_id % 4 = 2 then '' else concat('desk ', source) end"
_BOUNDS = "case when doc_id % 2 = 0 then concat('<{0}>', n_chars, ' W</{0}><{0}>', n_chars, '</{0}><{0}>1.5 N</{0}><{0}>-3e2</{0}>') else '<{0}>10</{0}><{0}>20</{0}>' end"
#: One document for each row, of three standards in turn; each eleventh is broken.
# one of eleven is not well formed and is repaired; one of thirteen has a document type and is not read
_XML = f"""concat(case when doc_id % 13 = 0 then '<!DOCTYPE metadata>' else '' end, case when doc_id % 3 = 0 then concat(
    '<metadata><dataIdInfo><idPurp>', {_PURPOSE}, '</idPurp><idAbs>', {_ABSTRACT}, '</idAbs><idPoC><n>', {_CONTACT}, '</n></idPoC><searchKeys><keyword>', lang, '</keyword></searchKeys><dataExt><GeoBndBox>', {_BOUNDS.format("v")},
    '</GeoBndBox></dataExt></dataIdInfo><outer><Esri><DataProperties><lineage><Process>x</Process></lineage></DataProperties></Esri></outer>')
when doc_id % 3 = 1 then concat(
    '<metadata><wrap><idinfo><descript><abstract>', {_ABSTRACT}, '</abstract><purpose>', {_PURPOSE}, '</purpose></descript><spdom><bounding>', {_BOUNDS.format("b")}, '</bounding></spdom><ptcontac>', {_CONTACT},
    '</ptcontac><keywords><themekey>', lang, '</themekey></keywords></idinfo></wrap>')
else concat(
    '<metadata><g:MD_Metadata xmlns:g="urn:g"><g:abstract><g:t>', {_ABSTRACT}, '</g:t></g:abstract><g:purpose><g:t>', {_PURPOSE}, '</g:t></g:purpose><g:contact>', {_CONTACT}, '</g:contact><g:EX_GeographicBoundingBox>', {_BOUNDS.format("g:b")},
    '</g:EX_GeographicBoundingBox><g:keyword>', lang, '</g:keyword><g:lineage><g:LI_Lineage>made by hand</g:LI_Lineage></g:lineage></g:MD_Metadata>') end,
case when doc_id % 11 = 0 then '<broken>' else '' end, '</metadata>')"""
_STATE = "case when {0} = '' then 'missing' when {0} in ('TBD', 'REQUIRED: a summary') then 'placeholder' else 'present' end"
_META = f"""select doc_id, case when broken then 'missing' else {_STATE.format("purpose")} end as summary, case when broken or abstract = '{_EMPTY_HTML}' then 'missing' else {_STATE.format("abstract")} end as description,
case when broken then 'missing' else 'present' end as tags, case when not broken and length(contact) >= 3 and contact <> 'TBD' then 'present' else 'missing' end as contact, case when not broken and doc_id % 2 = 0 then 'present' else 'missing' end as extent,
case when broken or doc_id % 3 = 1 then 'missing' when doc_id % 3 = 0 then 'auto' else 'present' end as lineage, case when not broken then case doc_id % 3 when 0 then 'ArcGIS' when 1 then 'FGDC CSDGM' else 'ISO 19139' end end as standard
from (select doc_id, doc_id % 13 = 0 as broken, {_PURPOSE} as purpose, {_ABSTRACT} as abstract, {_CONTACT} as contact from documents)"""
_ITEMS = ("summary", "description", "tags", "contact", "extent", "lineage")


def _evaluated(spark, sf):
    return read(spark, sf, "documents").selectExpr("doc_id", f"{_XML} as xml").select("doc_id", documents.metadata(F.col("xml")).alias("m"))


@query(_META)
def metadata_eval(spark, sf):
    return _evaluated(spark, sf).select("doc_id", *[f"m.{e}" for e in _ITEMS], "m.standard")


_WEIGHT = {"summary": 1.0, "description": 1.5, "tags": 1.0, "contact": 1.0, "extent": 0.75, "lineage": 1.0}
_GAINED = " + ".join(f"case {e} when 'present' then {w} when 'auto' then {w / 2} else 0.0 end" for e, w in _WEIGHT.items())


@query(f"select doc_id, round(100.0::double * ({_GAINED})::double / 8.0::double, 1) as score from ({_META})")
def metadata_score(spark, sf):
    return _evaluated(spark, sf).select("doc_id", documents.metadata_score(F.col("m")).alias("score"))


@query("""with r as (select row_number() over (order by doc_id) as pos, 'Class' || (doc_id % 700) as table_name, case when doc_id % 17 = 0 then 'geopackage' else 'table' end as scope, doc_id as id from labels),
a as (select *, scope = 'geopackage' as whole, case when scope <> 'geopackage' then lower(table_name) end as class from r),
l as (select whole, class, max(pos) as pos from a join documents on id = doc_id group by whole, class)
select l.class, md5(text) as document from l join a using (pos) join documents on a.id = doc_id where text is not null""")
def metadata_references(spark, sf):
    r = read(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.concat(F.lit("Class"), (F.col("doc_id") % 700).cast("string")).alias("table_name"), F.when(F.col("doc_id") % 17 == 0, "geopackage").otherwise("table").alias("reference_scope"), F.col("doc_id").alias("md_file_id"))
    m = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("metadata"))
    return geopackage.documents_of(m, r).where("document is not null").select("class", F.md5(F.col("document").cast("binary")).alias("document"))


@query(" union all ".join(f"select '{e}' as element, count(*) filter ({e} in ('missing', 'placeholder')) as lacking, count(*) filter ({e} = 'placeholder') as placeholders from ({_META})" for e in _ITEMS))
def metadata_items(spark, sf):
    rows = _evaluated(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"m.{e}").alias("state")) for e in _ITEMS])).alias("e")).select("e.*")
    return rows.groupBy("element").agg(F.count_if(F.col("state").isin("missing", "placeholder")).alias("lacking"), F.count_if(F.col("state") == "placeholder").alias("placeholders"))




@query("select doc_id, coalesce(regexp_matches(t, 'REQUIRED:|There is no description|No description available|^\\s*(none|n/?a|tbd|todo)\\s*$', 'i'), false) as hollow from p_hollow")
def placeholder_detect(spark, sf):
    return planted(spark, sf, "p_hollow").select("doc_id", text.is_placeholder(F.col("t")).alias("hollow"))


_PLAIN = "html"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_c}')"


@query(f"select page_id, trim(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')) as plain from pages")
def html_clean(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.html_clean(F.col("html")).alias("plain"))


# ---- assets ---------------------------------------------------------------------------------------

BASELINE = [("part", "Brand#1", "Economy", "essential"), ("part", "Brand#2", "STANDARD", "essential"), ("part", "Brand 3", "promo", "balanced"), ("part", "Brand#77", "Large", "balanced"), ("part", "Unknown", "x", "balanced"), ("other", "Brand#1", "Promo", "balanced")]
_BASE = values(BASELINE, "b(class_name, asset_group, asset_type, package)")
_PAIR = "select 'part' as class_name, brand as asset_group, kind as asset_type, count(*) as features from p_part group by all"


def _fold(c: str) -> str:
    return f"coalesce(case when {num(c)} = 0 then '' when {num(c)} = floor({num(c)}) then cast(cast({num(c)} as bigint) as varchar) else regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g') end, '')"


_EXACT = f"select p.*, exists (select 1 from {_BASE} where {_fold('b.class_name')} = {_fold('p.class_name')} and {_fold('b.asset_group')} = {_fold('p.asset_group')} and {_fold('b.asset_type')} = {_fold('p.asset_type')} and {_fold('p.asset_type')} <> '') as matched from ({_PAIR}) p"


def _baseline(spark):
    return inline(spark, "class_name string, asset_group string, asset_type string, package string", BASELINE)


@query(_PAIR)
def asset_pairs(spark, sf):
    return assets.pairs(planted(spark, sf, "p_part"), "part", "brand", "kind")


@query(f"select fid, {_fold('size_text')} as a, {_fold('brand')} as b from p_part")
def asset_norm(spark, sf):
    return planted(spark, sf, "p_part").select("fid", text.name_fold(F.col("size_text")).alias("a"), text.name_fold(F.col("brand")).alias("b"))


@query(_EXACT)
def asset_exact(spark, sf):
    return assets.exact(asset_pairs(spark, sf), _baseline(spark))


@query()
def asset_fuzzy(spark, sf):
    rest = asset_exact(spark, sf).where("not matched").drop("matched")
    return assets.fuzzy(rest, _baseline(spark))


@query(f"select class_name, asset_group from {_BASE} where class_name = 'part' and {_fold('asset_group')} not in ('', 'unknown') and {_fold('asset_group')} not in (select {_fold('brand')} from p_part)")
def asset_missing_groups(spark, sf):
    return assets.missing_groups(asset_pairs(spark, sf), _baseline(spark))


@query(f"""with u as (select distinct class_name, concat(coalesce(asset_group, '(none)'), ' / ', coalesce(asset_type, '(none)')) as label from ({_EXACT}) where not matched)
select class_name, count(*) as n, string_agg(label, '; ' order by label) filter (r <= 12) as labels from (select *, row_number() over (partition by class_name order by label) as r from u) group by 1""")
def asset_unmapped_rollup(spark, sf):
    return assets.unmapped_labels(asset_exact(spark, sf).where("not matched"))


@query("select p_brand as brand, p_type as kind, p_partkey as fid, p_name as name from part qualify row_number() over (partition by p_brand, p_type order by case when p_name like '%ring%' then 0 else 1 end, p_partkey) = 1")
def asset_baseline_build(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("fid"), F.col("p_name").alias("name"))
    return assets.preferred(rows, ["brand", "kind"], F.col("name").contains("ring"), "fid")


# ---- profiles -------------------------------------------------------------------------------------

_PROF = {"customer": ("c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"), "orders": ("o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double", "o_orderdate timestamp_ntz", "o_orderpriority string")}


def _field_sql(t: str, c: str, kind: str) -> str:
    blank = f"({c} is null or isnan({c}))" if kind == "double" else _BLANK.format(c) if kind == "string" else f"{c} is null"
    d = f"count(distinct {c})"
    return f"select '{t}' as layer, '{c}' as field, '{kind}' as type, count(*) as rows, count(*) filter ({blank}) as nulls, round(count(*) filter ({blank})::double / count(*), 4) as null_rate, case when {d} > 5000 then '>5000' else cast({d} as varchar) end as distinct, {d} = count(*) and {d} <= 5000 as key_candidate from {t}"


_PROFILE = " union all ".join(_field_sql(t, *c.split()) for t, cs in _PROF.items() for c in cs)


@query(_PROFILE)
def profile_fields(spark, sf):
    return trust.union(*[profiles.field_profile(read(spark, sf, t), t) for t in _PROF])


@query(f"select layer, max(rows) as rows, count(*) as fields, coalesce(string_agg(field, ',' order by field) filter (key_candidate), '') as key_candidates, coalesce(string_agg(field, ',' order by field) filter (null_rate >= 0.2), '') as weak_fields from ({_PROFILE}) group by 1")
def profile_layers(spark, sf):
    return profiles.layer_profile(profile_fields(spark, sf))




@query("""select id, case when l like '%storm%' then 'stormwater' when regexp_matches(l, 'sewer|sanitary|wastewater') then 'sewer' when l like '%water%' and not regexp_matches(l, 'storm|waste|sewer') then 'water' when regexp_matches(l, 'electric|transmission|distribution|power') then 'electric'
when regexp_matches(l, 'gas|pipeline|updm') then 'gas' when regexp_matches(l, 'communication|telecom|fiber') then 'communications' when regexp_matches(l, 'districtenergy|district_energy|district energy|steam') then 'district_energy' end as guess from (select id, lower(t) as l from p_topic)""")
def domain_guess(spark, sf):
    return planted(spark, sf, "p_topic").select("id", text.domain_guess(F.col("t")).alias("guess"))


# ---- lineage and geometry -------------------------------------------------------------------------


@query("select c_mktsegment as label, count(*) as n from customer group by 1 order by 2 desc, min(c_custkey) limit 1")
def crs_mode(spark, sf):
    return lineage.mode(read(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), "c_custkey"), "label", "c_custkey")




@query("""with l as (select * from p_systems),
m as (select horizontal from l where horizontal is not null group by 1 order by count(*) desc, min(pos) limit 1),
f as (select count(*) filter (horizontal is null) as undefined, count(distinct horizontal) as horizontals, count(distinct coalesce(vertical, '(none)')) as verticals,
    bool_or(has_z) and bool_and(coalesce(vertical, '(none)') = '(none)') as flat_z, (select bool_or(geographic) from l join m using (horizontal)) as geographic_main from l)
select *, (greatest(0, 100 - case when undefined > 0 then 40 else 0 end - case when horizontals > 1 then 40 else 0 end - case when verticals > 1 then 15 else 0 end
    - case when flat_z then 10 else 0 end - case when geographic_main then 10 else 0 end))::double as score from f""")
def crs_consistency(spark, sf):
    return lineage.crs_deductions(planted(spark, sf, "p_systems"))




@query("""select id, not coalesce(wkt, '') = '' as defined, case when wkt <> '' then case kind when 0 then concat('geo ', c_name) when 1 then concat('zone ', nation) when 2 then concat('both ', c_name) else c_name end end as name,
case kind when 0 then concat('geo ', c_name) when 1 then concat('zone ', nation) when 2 then concat('zone ', nation) end as horizontal, case when kind = 2 then concat('height ', nation) end as vertical,
(case kind when 0 then 4000 + c_nationkey when 1 then 26900 + c_nationkey end)::int as epsg, case when kind < 2 then concat('d', nation) when kind = 2 then 'd1' end as datum, case kind when 0 then 'degree' when 1 then 'metre' when 2 then 'foot' end as unit,
case kind when 0 then 111320::double when 1 then 1::double when 2 then 0.3048::double end as unit_m, kind = 0 as geographic from p_wkt""")
def crs_table(spark, sf):
    return planted(spark, sf, "p_wkt").select("id", documents.crs(F.col("wkt")).alias("c")).select("id", "c.*")


_EV = "select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as double) as x, value as y from events"
_SEG = f"select event_id, user_id as owner, event_type as layer, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from ({_EV}) window w as (partition by user_id order by event_id)"


def _points(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"))


def _segments(spark, sf):
    """Consecutive events of a user: a window over the users' own tracks, the time series that the segments are."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    p = _points(spark, sf).withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    return p.where("x2 is not null").select("event_id", F.col("user_id").alias("owner"), F.col("event_type").alias("layer"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def _shape(c1: str = "x1", c2: str = "y1", c3: str = "x2", c4: str = "y2"):
    v = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(None).cast("double").alias("z"))
    return F.array(F.array(F.array(v(c1, c2), v(c3, c4))))


_BOX = " union all ".join(f"select vec_id % 2 as side, {k} as pair, 100.0 * embedding[{2 * k + 1}]::double as x, 100.0 * embedding[{2 * k + 2}]::double as y from embeddings" for k in range(4))


@query(f"""select *, west >= -180 and east <= 180 and south >= -90 and north <= 90 as plausible
from (select side, pair, min(x) as west, min(y) as south, max(x) as east, max(y) as north from ({_BOX}) group by all)""")
def geo_bounds(spark, sf):
    e = read(spark, sf, "embeddings")
    at = lambda i: 100.0 * F.col("embedding")[i].cast("double")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), at(2 * k).alias("x"), at(2 * k + 1).alias("y")) for k in range(4)]))
    b = e.select((F.col("vec_id") % 2).alias("side"), pairs.alias("p")).select("side", "p.*").groupBy("side", "pair").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    return b.withColumn("plausible", lineage.plausible_degrees(*map(F.col, ("west", "south", "east", "north"))))


# two polygons of each vector: a four-cornered one, and a triangle with a hole of half its size at its first corner
_QUAD, _TRI = [(0, 1), (2, 3), (4, 5), (6, 7)], [(8, 9), (10, 11), (12, 13)]


def _shoelace(corners: list[tuple[str, str]]) -> str:
    return "abs(" + " + ".join(f"({a} * {d} - {c} * {b})" for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True)) + ") / 2"


def _around(corners: list[tuple[str, str]]) -> str:
    return " + ".join(f"sqrt(({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b}))" for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True))


_E = lambda i: f"embedding[{i + 1}]::double"
_SQL_QUAD, _SQL_TRI = [(_E(i), _E(j)) for i, j in _QUAD], [(_E(i), _E(j)) for i, j in _TRI]
_SQL_HOLE = [(f"(({x} + {_SQL_TRI[0][0]}) / 2)", f"(({y} + {_SQL_TRI[0][1]}) / 2)") for x, y in _SQL_TRI]


def _ring(corners: list[tuple[int, int]], halved: bool = False, same=None):
    """A closed ring of a vector's numbers; halved towards its first corner; ``same``: where the second half repeats the first."""
    at = lambda i: F.col("embedding")[i].cast("double")
    first = corners[0]
    xy = [((at(i) + at(first[0])) / 2, (at(j) + at(first[1])) / 2) if halved else (at(i), at(j)) for i, j in corners]
    if same is not None:
        xy = [*xy[:2], *[(F.when(same, xy[k][0]).otherwise(x), F.when(same, xy[k][1]).otherwise(y)) for k, (x, y) in enumerate(xy[2:])]]
    return F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(None).cast("double").alias("z")) for x, y in [*xy, xy[0]]])


@query(f"""select vec_id, {_around(_SQL_QUAD)} + {_around(_SQL_TRI)} + {_around(_SQL_HOLE)} as length,
{_shoelace(_SQL_QUAD)} + {_shoelace(_SQL_TRI)} - {_shoelace(_SQL_HOLE)} as area from embeddings""")
def geo_areas(spark, sf):
    shape = F.array(F.array(_ring(_QUAD)), F.array(_ring(_TRI), _ring(_TRI, halved=True)))
    return read(spark, sf, "embeddings").select("vec_id", geometry.length(shape).alias("length"), geometry.area(shape).alias("area"))


@query(f"select event_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length, x1 = x2 and y1 = y2 as zero from ({_SEG}) where x2 is not null")
def geo_measures(spark, sf):
    s = _segments(spark, sf).withColumn("g", _shape())
    return s.select("event_id", geometry.length(F.col("g")).alias("length"), (geometry.length(F.col("g")) == 0).alias("zero"))


@query("select event_type, count(*) filter (event_id % 13 = 0) as empty, count(*) as rows from events group by 1")
def geo_empty(spark, sf):
    p = _points(spark, sf).withColumn("g", F.when(F.col("event_id") % 13 == 0, None).otherwise(_shape("x", "y", "x", "y")))
    return p.groupBy("event_type").agg(F.count_if(geometry.is_empty(F.col("g"))).alias("empty"), F.count("*").alias("rows"))


def _turn(o: str, u: str, v: str) -> str:
    return f"sign((x{u} - x{o}) * (y{v} - y{o}) - (y{u} - y{o}) * (x{v} - x{o}))"


def _crossing(a: str, b: str, c: str, d: str) -> str:
    return f"({_turn(a, b, c)} * {_turn(a, b, d)} <= 0 and {_turn(c, d, a)} * {_turn(c, d, b)} <= 0)"


@query(f"""select reason, count(*) as n from (
    select case when (select count(distinct v) from unnest([(x0, y0), (x1, y1), (x2, y2), (x3, y3)]) as t(v)) < 3 then 'Too few points in geometry component'
        when {_crossing("0", "1", "2", "3")} or {_crossing("1", "2", "3", "0")} then 'Self-intersection' else 'valid' end as reason
    from (select x0, y0, x1, y1, case when twin then x0 else x2 end as x2, case when twin then y0 else y2 end as y2, case when twin then x1 else x3 end as x3, case when twin then y1 else y3 end as y3
        from (select vec_id % 7 = 0 as twin, {", ".join(f"{x} as x{k}, {y} as y{k}" for k, (x, y) in enumerate(_SQL_QUAD))} from embeddings))) group by 1""")
def geo_validity(spark, sf):
    shape = F.array(F.array(_ring(_QUAD, same=F.col("vec_id") % 7 == 0)))
    return read(spark, sf, "embeddings").select(F.coalesce(geometry.invalid_reason(F.lit("polygon"), shape), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _double(n: str) -> str:
    """SQL: the 16 hexadecimal digits of a positive whole number as a double, high byte first."""
    e = f"(length(bin({n})) - 1)"
    return f"lpad(hex(shiftleft(cast(1023 + {e} as bigint), 52) + shiftleft({n} - shiftleft(1L, {e}), 52 - {e})), 16, '0')"


@query("""select o_orderkey, o_orderkey % 11 = 0 as empty, case when o_orderkey % 11 = 0 then 0 else 2 end as n_ends, case when o_orderkey % 11 = 0 then 0 else sqrt((o_orderkey % 7) * (o_orderkey % 7) + 9.0::double) end as length,
case when o_orderkey % 11 <> 0 then (o_custkey + 1 + o_orderkey % 7)::double end as last_x from orders""")
def geo_wkb(spark, sf):
    """A line for each order as WKB, some cut short, decoded and measured."""
    ends = ("(o_custkey + 1)", "(o_orderkey + 1)", "(o_custkey + 1 + o_orderkey % 7)", "(o_orderkey + 4)")
    wkb = f"unhex(concat('000000000200000002', {', '.join(map(_double, ends))}))"
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", f"case when o_orderkey % 11 = 0 then substring({wkb}, 1, 30) else {wkb} end as w")
    g = F.col("g")
    out = rows.select("o_orderkey", geometry.from_wkb("w").alias("g"))
    return out.select("o_orderkey", geometry.is_empty(g).alias("empty"), F.size(geometry.ends(g)).alias("n_ends"), geometry.length(g).alias("length"), F.try_element_at(geometry.ends(g), F.lit(2))["x"].alias("last_x"))


@query(f"select round(x, 4) as x, round(y, 4) as y, count(*) as members from ({_EV}) group by all having count(*) > 1")
def geo_stacked_points(spark, sf):
    return network.stacked_points(_points(spark, sf))


@query("""select event_type, count(*) as vertices, count(*) filter (z = 0 or z is null or isnan(z)) as zero, count(*) filter (z = 0 or z is null or isnan(z)) >= 0.999 * count(*) as flat
from (select event_type, case when value < 1 or event_type = 'view' and event_id % 2000 <> 0 then 0.0::double when event_id % 5 = 0 then 'NaN'::double else value end as z from events) group by 1""")
def geo_z_flat(spark, sf):
    z = F.when((F.col("value") < 1) | (F.col("event_type") == "view") & (F.col("event_id") % 2000 != 0), 0.0).when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    return network.z_statistics(read(spark, sf, "events"), z, "event_type")


_T = "case when s.dx * s.dx + s.dy * s.dy > 0 then greatest(0.0::double, least(1.0::double, ((e.x - s.x1) * s.dx + (e.y - s.y1) * s.dy) / (s.dx * s.dx + s.dy * s.dy))) else 0.0::double end"
_D2 = "(e.x - (s.x1 + t * s.dx)) * (e.x - (s.x1 + t * s.dx)) + (e.y - (s.y1 + t * s.dy)) * (e.y - (s.y1 + t * s.dy))"
_STATES = f"""(with g as ({_SEG}), s as (select distinct owner, x1, y1, x2 - x1 as dx, y2 - y1 as dy from g where x2 is not null),
e as (select layer, owner, x, y, count(*) as n from (select layer, owner, x1 as x, y1 as y from g where x2 is not null union all select layer, owner, x2, y2 from g where x2 is not null) group by all),
d as (select e.layer, e.owner, e.x, e.y, min({_D2.replace('t *', f'({_T}) *')}) as d2 from e join s on e.owner <> s.owner group by all)
select e.layer, e.owner, e.x, e.y, e.n, case when d2 <= 0.001::double * 0.001::double then 'connected' when d2 <= 0.25 then 'near miss' else 'dangle' end as state from e left join d using (layer, owner, x, y))"""


def _states(spark, sf):
    s = _segments(spark, sf)
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return network.endpoint_states(s.withColumn("ends", ends))


@query(f"select state, sum(n)::bigint as endpoints from {_STATES} group by 1")
def geo_dangles(spark, sf):
    return _states(spark, sf).groupBy("state").agg(F.sum("n").alias("endpoints"))


@query(f"""select layer, sum(n)::bigint as endpoints, coalesce(sum(n) filter (state = 'near miss'), 0)::bigint as near_miss, coalesce(sum(n) filter (state = 'dangle'), 0)::bigint as dangles,
100.0::double * (1.0::double - least(1.0::double, (5.0::double * coalesce(sum(n) filter (state = 'near miss'), 0)::double + 0.5::double * coalesce(sum(n) filter (state = 'dangle'), 0)::double) / sum(n)::double)) as score from {_STATES} group by 1""")
def geo_connectivity(spark, sf):
    return network.connectivity(_states(spark, sf))


@query(f"""with s as (select x1, y1, x2 - x1 as dx, y2 - y1 as dy from ({_SEG}) where x2 is not null), e as (select c_custkey as id, c_custkey % 100 + 0.5::double as x, c_acctbal / 100.0 as y from customer)
select id from e where not exists (select 1 from s where {_D2.replace('t *', f'({_T}) *')} <= 0.05::double * 0.05::double)""")
def geo_orphan_junctions(spark, sf):
    p = read(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 100 + 0.5).alias("x"), (F.col("c_acctbal") / 100.0).alias("y"))
    return network.orphan_points(p, _segments(spark, sf), 0.05).select(F.col("owner").alias("id"))


@query()
def geo_geojson(spark, sf):
    s = _segments(spark, sf)
    return s.select("event_id", geometry.geojson(F.lit("line"), _shape(), F.struct("layer", "owner")).alias("feature"))


_UTM = 'PROJCS["WGS 84 / UTM zone 16N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-87],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]'
_CONE = 'PROJCS["NAD83 / Texas South Central",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",30.2833333333333],PARAMETER["standard_parallel_2",28.3833333333333],PARAMETER["latitude_of_origin",27.8333333333333],PARAMETER["central_meridian",-99],PARAMETER["false_easting",1968500],PARAMETER["false_northing",13123333.333333333],UNIT["US survey foot",0.304800609601219]]'
_UTM_P, _CONE_P = projection.parse(_UTM), projection.parse(_CONE)


def _sums(table, n: float, of: str) -> str:
    return " + ".join(f"({c!r}::double) * {of.replace('@', str(2 * j) + '.0::double * ')}" for j, c in enumerate(projection.series(table, n), 1))


def _projected_sql() -> str:
    """Both projections of p_customer-like points, and the way back from the first one, by the same series."""
    u, c = _UTM_P, _CONE_P
    n, radius, origin = c.cone()
    size = u.k0 * u.rectifying
    return f"""with p as (select c_custkey as id, -93.0 + (c_custkey % 1201) / 100.0::double as lon, 24.0 + (c_custkey % 2503) / 100.0::double as lat from customer),
r as (select id, radians(lon) - ({u.lon0!r}::double) as far, radians(lon) - ({c.lon0!r}::double) as turn, asinh(tan(radians(lat))) - {u.e!r}::double * atanh({u.e!r}::double * sin(radians(lat))) as psi,
    asinh(tan(radians(lat))) - {c.e!r}::double * atanh({c.e!r}::double * sin(radians(lat))) as iso from p),
t as (select *, atan2(sinh(psi), cos(far)) as xi, asinh(sin(far) / sqrt(sinh(psi) * sinh(psi) + cos(far) * cos(far))) as eta from r),
m as (select id, turn, iso, eta + {_sums(projection.FORWARD, u.n, "cos(@xi) * sinh(@eta)")} as east, xi + {_sums(projection.FORWARD, u.n, "sin(@xi) * cosh(@eta)")} as north from t),
b as (select *, north - ({_sums(projection.INVERSE, u.n, "sin(@north) * cosh(@east)")}) as xi, east - ({_sums(projection.INVERSE, u.n, "cos(@north) * sinh(@east)")}) as eta from m),
k as (select *, atan(sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi))) as chi from b)
select id, round(500000 + {size!r}::double * east, 3) as utm_x, round({size!r}::double * north, 3) as utm_y,
    round(({c.fe!r}::double + {radius!r}::double * exp(-({n!r}::double) * iso) * sin({n!r}::double * turn)) / {c.unit!r}::double, 3) as cone_x,
    round(({c.fn!r}::double + {origin!r}::double - {radius!r}::double * exp(-({n!r}::double) * iso) * cos({n!r}::double * turn)) / {c.unit!r}::double, 3) as cone_y,
    round(degrees(atan2(sinh(eta), cos(xi)) + ({u.lon0!r}::double)), 7) as lon, round(degrees(chi + {_sums(projection.LATITUDE, u.n, "sin(@chi)")}), 7) as lat
from k"""


@query(_projected_sql())
def geo_projected(spark, sf):
    lon, lat = -93.0 + (F.col("c_custkey") % 1201) / 100.0, 24.0 + (F.col("c_custkey") % 2503) / 100.0
    utm, cone = (projection.between(projection.DEGREES, p) for p in (_UTM_P, _CONE_P))
    flat = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), utm(lon, lat).alias("utm"), cone(lon, lat).alias("cone"))
    back = flat.select("*", projection.between(_UTM_P, projection.DEGREES)(F.col("utm.x"), F.col("utm.y")).alias("back"))
    metres = [F.round(f"{c}.{k}", 3).alias(f"{c}_{k}") for c in ("utm", "cone") for k in ("x", "y")]
    return back.select("id", *metres, F.round("back.x", 7).alias("lon"), F.round("back.y", 7).alias("lat"))


@query("select quantile_disc(c_acctbal, 0.08) as west, quantile_disc(c_custkey, 0.08)::double as south, quantile_disc(c_acctbal, 0.92) as east, quantile_disc(c_custkey, 0.92)::double as north from customer")
def geo_map_extent(spark, sf):
    return trust.extent(read(spark, sf, "customer"), "c_acctbal", "c_custkey")


# ---- scores ---------------------------------------------------------------------------------------

_BY = "select o_orderpriority as label, count(*) filter (o_orderstatus = 'P') as bad, count(*) as total from orders group by 1"
_PEN = "greatest(0.0::double, 100.0 - 2.0 * 100.0 * (bad::double / total::double))"


@query(f"select label, bad, total, {_PEN} as score from ({_BY}) union all select 'none', 0, 0, null")
def score_components(spark, sf):
    n = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("bad"), F.count("*").alias("total"))
    return n.unionByName(inline(spark, "label string, bad long, total long", [("none", 0, 0)])).withColumn("score", scoring.penalty(F.col("bad"), F.col("total"), 2.0))


_STAGES = [("metadata", 20.0), ("lineage", 15.0), ("schema", 25.0), ("quality", 40.0)]
_OF = "case when label like '1%' then 'metadata' when label like '2%' then 'schema' when label = 'none' then 'lineage' else 'quality' end"
_STAGED = f"select {_OF} as stage, round(sum(score * w) filter (score is not null) / sum(w) filter (score is not null), 1) as score from (select label, {_PEN} as score, 1.0::double + bad % 3 as w from ({_BY}) union all select 'none', null, 1.0) group by 1"


@query(_STAGED)
def score_stages(spark, sf):
    stage = F.when(F.col("label").startswith("1"), "metadata").when(F.col("label").startswith("2"), "schema").when(F.col("label") == "none", "lineage").otherwise("quality")
    c = score_components(spark, sf).withColumns({"stage": stage, "w": 1.0 + F.col("bad") % 3})
    return c.groupBy("stage").agg(F.round(scoring.mean_by_weight(F.col("score"), F.col("w")), 1).alias("score"))


@query(f"select round(sum(score * weight) filter (score is not null) / sum(weight) filter (score is not null), 1) as score from ({_STAGED}) join {values(_STAGES, 's(stage, weight)')} using (stage)")
def score_overall(spark, sf):
    s = score_stages(spark, sf).join(F.broadcast(inline(spark, "stage string, weight double", _STAGES)), "stage")
    return s.agg(F.round(scoring.mean_by_weight(F.col("score"), F.col("weight")), 1).alias("score"))


_GRADE = "case when s is null then 'n/a' when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end"


@query(f"select grade, count(*) as n from (select {_GRADE} as grade from (select case when c_custkey % 50 = 0 then null else c_acctbal / 100.0 end as s from customer)) group by 1")
def score_grade(spark, sf):
    s = F.when(F.col("c_custkey") % 50 == 0, None).otherwise(F.col("c_acctbal") / 100.0)
    return read(spark, sf, "customer").select(scoring.grade(s).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@query("select kind, sum(score * w) / sum(w) as mean from (select o_orderstatus as kind, o_totalprice as score, case when o_orderpriority like '1%' then 2.0 else 1.0 end as w from orders) group by 1")
def weighted_means(spark, sf):
    w = F.when(F.col("o_orderpriority").startswith("1"), 2.0).otherwise(1.0)
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(scoring.mean_by_weight(F.col("o_totalprice"), w).alias("mean"))


# ---- findings -------------------------------------------------------------------------------------

_BASE_FINDINGS = f"""(select 'quality' as stage, 'required' as "check", severity, layer, concat(cast(empty as varchar), ' of the values in ', field, ' are blank') as message, empty as count from (select layer, field, empty, case when upper(field) = 'GLOBALID' then 'critical' when field in ('segment', 'status') then 'error' else 'warning' end as severity from ({_NULLS}) where empty > 0)
union all select 'quality', 'duplicates', 'critical', 'lineitem', concat(cast(members as varchar), ' rows share a key'), members from (select coalesce(sum(members), 0)::bigint as members from ({_LI}))
union all select 'schema', 'coded values', 'error', 'orders', concat(cast(count(*) as varchar), ' values in ', domain, ' are no code'), count(*) from ({_TEXT.format('')}) group by domain
union all select 'discover', 'inventory', 'info', '', concat(cast(count(*) as varchar), ' regions'), count(*) from region)"""
_RULE = "substr(lower(trim(regexp_replace(regexp_replace(message, '\\d[\\d,.\\x{a0}]*', '#', 'g'), '\\s+', ' ', 'g'))), 1, 300)"
_CLASS = "case when severity = 'info' and stage <> 'discover' then 'observation' when stage = 'quality' then 'defect' when stage = 'schema' then 'conformance' when stage = 'discover' then 'discovery' else 'observation' end"
_ID = f"substr(sha256(concat('assay-finding-1', chr(10), \"check\", chr(10), layer, chr(10), {_RULE})), 1, 20)"
_ALL = f"""select 'sample' as dataset, stage, "check", severity, layer, message, count, {_RULE} as rule, {_CLASS} as classification, {_ID} as finding_id from {_BASE_FINDINGS}"""


def findings(spark, sf):
    c = lambda s: F.lit(s).alias
    said = lambda n, *t: F.concat(F.col(n).cast("string"), *t)
    nulls = required_nulls_severity(spark, sf).select(c("quality")("stage"), c("required")("check"), "severity", "layer", said("empty", F.lit(" of the values in "), F.col("field"), F.lit(" are blank")).alias("message"), F.col("empty").alias("count"))
    dup = dup_within_class(spark, sf).select(c("quality")("stage"), c("duplicates")("check"), c("critical")("severity"), c("lineitem")("layer"), said("members", F.lit(" rows share a key")).alias("message"), F.col("members").alias("count"))
    coded = domain_coded_text(spark, sf).groupBy("domain").agg(F.count("*").alias("n")).select(c("schema")("stage"), c("coded values")("check"), c("error")("severity"), c("orders")("layer"), said("n", F.lit(" values in "), F.col("domain"), F.lit(" are no code")).alias("message"), F.col("n").alias("count"))
    info = read(spark, sf, "region").agg(F.count("*").alias("n")).select(c("discover")("stage"), c("inventory")("check"), c("info")("severity"), c("")("layer"), said("n", F.lit(" regions")).alias("message"), F.col("n").alias("count"))
    base = trust.union(nulls, dup, coded, info).withColumns({"dataset": F.lit("sample"), "ids": F.lit(""), "detail": F.lit("")})
    return trust.complete(base)


_COLS = ["dataset", "stage", "check", "severity", "layer", "message", "count", "rule", "classification", "finding_id"]


@query(_ALL)
def findings_all(spark, sf):
    return findings(spark, sf).select(*_COLS)


@query(f"select finding_id, severity, count, cast(case severity when 'critical' then 0 when 'error' then 1 when 'warning' then 2 else 3 end as int) as rank from ({_ALL})")
def findings_sorted(spark, sf):
    return trust.ordered(findings(spark, sf)).select("finding_id", "severity", "count", "rank")


@query(f"select finding_id, message from ({_ALL}) where severity in ('critical', 'error') and lower(concat(message, ' ', layer, ' ', \"check\")) like '%key%'")
def findings_filter(spark, sf):
    return trust.search(findings(spark, sf), ["critical", "error"], text="KEY").select("finding_id", "message")


@query("select c_custkey, substr(sha256(concat('assay-finding-1', chr(10), 'names', chr(10), c_mktsegment, chr(10), 'rule', chr(10), array_to_string(list_sort(list_distinct([cast(c_custkey as varchar), cast(c_nationkey as varchar)])), chr(10)))), 1, 20) as finding_id from customer")
def finding_id(spark, sf):
    keys = F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    return read(spark, sf, "customer").select("c_custkey", trust.finding_id(F.lit("names"), F.col("c_mktsegment"), F.lit("rule"), keys).alias("finding_id"))


@query(f"select finding_id, classification, case classification {' '.join(f"when '{k}' then '{v}'" for k, v in trust.ACTIONS.items())} end as action from ({_ALL})")
def finding_classify(spark, sf):
    return findings(spark, sf).select("finding_id", "classification", "action")


@query("select n, substr(lower(trim(regexp_replace(regexp_replace(m, '\\d[\\d,.\\x{a0}]*', '#', 'g'), '\\s+', ' ', 'g'))), 1, 300) as rule from (select c_custkey as n, concat('  ', c_name, ' has ', cast(c_custkey as varchar), ',000.5 of  ', c_mktsegment, ' ') as m from customer)")
def rule_key(spark, sf):
    return read(spark, sf, "customer").selectExpr("c_custkey as n", "concat('  ', c_name, ' has ', cast(c_custkey as string), ',000.5 of  ', c_mktsegment, ' ') as m").select("n", text.rule_key(F.col("m")).alias("rule"))




@query("select id, coalesce(case when regexp_matches(c, '^[=+\\-@\\t\\r]') and not regexp_matches(c, '^\\s*[+-]?((\\d+(_\\d+)*(\\.(\\d+(_\\d+)*)?)?|\\.\\d+)(e[+-]?\\d+)?|inf(inity)?|nan)\\s*$', 'i') then concat('''', c) else c end, '') as safe from p_cell")
def csv_safe(spark, sf):
    return planted(spark, sf, "p_cell").select("id", text.csv_safe(F.col("c")).alias("safe"))


@query("select * from (select severity, count(*) as n from (" + _ALL + ") group by 1)")
def severity_totals(spark, sf):
    return findings(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


@query("select stage, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'error') as error, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'info') as info from (" + _ALL + ") group by 1")
def severity_counts(spark, sf):
    return trust.severity_counts(findings(spark, sf), "stage")


def _closed(spark, sf):
    rows = findings(spark, sf).where("severity = 'warning'").select("finding_id", F.lit("closed").alias("status"), F.lit("known").alias("note"))
    return trust.dispose(findings(spark, sf), rows)


@query(f"select finding_id, case when severity = 'warning' then 'CLOSED' else 'OPEN' end as disposition, case when severity = 'warning' then 'known' end as disposition_note from ({_ALL})")
def dispositions_apply(spark, sf):
    return _closed(spark, sf).select("finding_id", "disposition", "disposition_note")


@query(f"""select dataset, stage, "check", layer, severity, string_agg(finding_id, ',' order by finding_id) as finding_ids, concat('Is the ''', "check", ''' result on ', case when layer = '' then 'the dataset' else layer end, ' expected, and if not, who will correct it?') as question,
case stage when 'quality' then 'Data editor' when 'schema' then 'Data modeler' else 'GIS administrator' end as role, case severity when 'critical' then 'urgent' when 'error' then 'high' else 'low' end as priority from ({_ALL}) where severity <> 'warning' group by all""")
def questions_rollup(spark, sf):
    return trust.questions(_closed(spark, sf)).drop("rank", "why_it_matters")


_SIGNED = "sha256(array_to_string([finding_id, \"check\", layer, severity, message, cast(count as varchar), stage, rule, classification], chr(10)))"


@query(f"select sha256(string_agg(h, chr(10) order by h)) as signature, count(*) as rows from (select {_SIGNED} as h from ({_ALL}))")
def signature(spark, sf):
    return trust.signature(findings(spark, sf))


# two runs of one count for each nation: some names and counts differ by expression
_BEFORE, _AFTER = "case when n_nationkey % 6 = 1 then concat(n_name, ' old') else n_name end", "case when n_nationkey % 6 = 3 then concat(n_name, ' new') else n_name end"
_GONE = "c_custkey % 9 = 0 and n_nationkey % 4 = 0"


@query(f"""with r as (select * from nation join customer on c_nationkey = n_nationkey),
a as (select {_BEFORE} as k, count(*) as n, min(c_name) as first from r group by 1), b as (select {_AFTER} as k, count(*) filter (not ({_GONE})) as n, min(c_name) as first from r group by 1),
j as (select coalesce(a.k, b.k) as k, a.k is null as newer, b.k is null as older, a.n as an, b.n as bn, a.first as af, b.first as bf from a full join b on a.k = b.k)
select k as name, 'present' as field, case when older then 'yes' end as before, case when newer then 'yes' end as after from j where newer or older
union all select k, 'n', cast(an as varchar), cast(bn as varchar) from j where not newer and not older and an <> bn
union all select k, 'first', af, bf from j where not newer and not older and af <> bf""")
def run_diff(spark, sf):
    r = read(spark, sf, "nation").join(read(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = r.groupBy(F.expr(_BEFORE).alias("name")).agg(F.count("*").alias("n"), F.min("c_name").alias("first"))
    b = r.groupBy(F.expr(_AFTER).alias("name")).agg(F.count_if(~F.expr(_GONE)).alias("n"), F.min("c_name").alias("first"))
    return trust.run_diff(a, b, "name", ["n", "first"])


OVERLAY = [("null_required", "warning"), ("coded_value", "info")]
DEFAULTS = [("null_required", "error"), ("null_optional", "warning"), ("duplicate_globalid", "critical"), ("coded_value", "error")]


@query(f"select e.key, coalesce(o.severity, d.severity) as severity, count(*) as n from p_emitted e left join {values(DEFAULTS, 'd(key, severity)')} on d.key = e.key left join {values(OVERLAY, 'o(key, severity)')} on o.key = e.key group by 1, 2")
def rules_severity(spark, sf):
    d, o = inline(spark, "key string, severity string", DEFAULTS), inline(spark, "key string, other string", OVERLAY)
    found = planted(spark, sf, "p_emitted").groupBy("key").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(d), "key", "left").join(F.broadcast(o), "key", "left").select("key", F.coalesce("other", "severity").alias("severity"), "n")


@query("select event_id as seq, event_type as kind from events where event_id >= 500")
def event_log_since(spark, sf):
    return events.events_since(read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")), 500)


@query("select event_type, event_id from events qualify row_number() over (partition by event_type order by md5(cast(event_id as varchar)), event_id) <= 50")
def sample_flagged(spark, sf):
    return trust.hash_sample(read(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 50)


@query()
def input_hash(spark, sf):
    return sinks.input_hash(sinks.input_hashes(spark, sf))


@query("select 'failed' as status, cast(null as double) as score, 'n/a' as grade")
def failed_dataset(spark, sf):
    got = run.validate(dataset.Dataset(spark, "gone", {}, errors={"t": "no such file"}))
    return spark.createDataFrame([(got.status, got.score, got.grade)], "status string, score double, grade string")


_G = "cast(floor(c_custkey / 20) as bigint)"


_CUT = "regexp_replace({}, '</[^<>]*>$', '')"


def _grouped_xml(spark, sf, element: str, whole: str):
    """A document for each 20 customers: whole, an expression over g, low, high and the joined elements; of seven, one is no XML and one is cut before its last end tag; both are repaired where they can be."""
    e = read(spark, sf, "customer").selectExpr(f"{_G} as g", "c_custkey", "c_acctbal", f"{element} as e").groupBy("g")
    rows = e.agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "e"))), lambda x: x["e"]), "").alias("elements"))
    return rows.selectExpr("g", f"case when g % 7 = 6 then '<broken' when g % 7 = 5 then {_CUT.format(whole)} else {whole} end as xml").withColumn("xml", documents.repaired(F.col("xml")))


@query(f"""select g, case when ok then count(*) else 0 end as n_fields, case when ok then count(*) filter (c_custkey % 2 = 0) else 0 end as n_nullable, case when ok then count(*) filter (c_custkey % 3 = 0) else 0 end as n_domains, case when ok then 'ASSETGROUP' end as subtype_field,
case when ok then coalesce(string_agg(concat(c_custkey, '=', c_name), ',' order by c_custkey) filter (c_custkey % 5 = 0), '') else '' end as subtypes, case when ok then g % 2 = 0 end as has_z, case when ok then false end as has_m, case when ok then 'Line' end as shape_type, case when ok then (g + 1)::double / 8 end as xy_tolerance
from (select *, {_G} as g, {_G} % 7 <> 6 as ok from customer) group by g, ok""")
def catalog_classes(spark, sf):
    field = "concat('<GPFieldInfoEx xsi:type=\"x\"><Name>F', c_custkey, '</Name><FieldType>esriFieldTypeInteger</FieldType><IsNullable>', c_custkey % 2 = 0, '</IsNullable>', case when c_custkey % 3 = 0 then '<DomainName>D</DomainName>' else '' end, '</GPFieldInfoEx>', '|', '<Subtype><SubtypeName>', c_name, '</SubtypeName><SubtypeCode>', case when c_custkey % 5 = 0 then cast(c_custkey as string) else 'x' end, '</SubtypeCode></Subtype>', '|')"
    part = lambda k: f"array_join(transform(filter(split(elements, '[|]'), x -> startswith(x, '{k}')), x -> x), '')"
    whole = f"concat('<DEFeatureClassInfo xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\"><HasZ>', g % 2 = 0, '</HasZ><HasM>false</HasM><ShapeType>Line</ShapeType><XYTolerance>', (g + 1) / 8D, '</XYTolerance><SubtypeFieldName>ASSETGROUP</SubtypeFieldName><GPFieldInfoExs>', {part('<GPField')}, '</GPFieldInfoExs><Subtypes>', {part('<Subtype>')}, '</Subtypes></DEFeatureClassInfo>')"
    c = _grouped_xml(spark, sf, field, whole).select("g", documents.class_definition(F.col("xml")).alias("c"))
    n = lambda test: F.size(F.filter("c.fields", test)).cast("long")
    subtypes = F.array_join(F.transform("c.subtypes", lambda s: F.concat(s["code"].cast("string"), F.lit("="), s["name"])), ",").alias("subtypes")
    return c.select("g", n(lambda f: F.lit(True)).alias("n_fields"), n(lambda f: f["nullable"]).alias("n_nullable"), n(lambda f: f["domain"].isNotNull()).alias("n_domains"), "c.subtype_field", subtypes, "c.has_z", "c.has_m", "c.shape_type", "c.xy_tolerance")


@query(f"""select g, case when g % 7 <> 6 then concat('Domain', g) end as name, case when g % 7 <> 6 and g % 3 > 0 then 'coded' else 'range' end as kind, case when g % 7 <> 6 then case when g % 3 = 1 then 'esriFieldTypeSmallInteger' else 'esriFieldTypeDouble' end end as field_type,
case when g % 7 <> 6 and g % 3 > 0 then string_agg(concat(c_custkey, case when g % 3 = 2 then '.0' else '' end, '=', c_name), ',' order by c_custkey) else '' end as codes, case when g % 7 <> 6 and g % 3 = 0 then min(c_acctbal)::double end as min, case when g % 7 <> 6 and g % 3 = 0 then max(c_acctbal)::double end as max
from (select *, {_G} as g from customer) group by g""")
def catalog_domains(spark, sf):
    value = f"concat('<CodedValue><Name>', c_name, '</Name><Code>', c_custkey, case when {_G} % 3 = 1 then '.0' else '' end, '</Code></CodedValue>')"
    coded = "concat('<GPCodedValueDomain2><DomainName>Domain', g, '</DomainName><FieldType>', case when g % 3 = 1 then 'esriFieldTypeSmallInteger' else 'esriFieldTypeDouble' end, '</FieldType><CodedValues>', elements, '</CodedValues></GPCodedValueDomain2>')"
    ranged = "concat('<GPRangeDomain2><DomainName>Domain', g, '</DomainName><FieldType>esriFieldTypeDouble</FieldType><MinValue>', low, '</MinValue><MaxValue>', high, '</MaxValue></GPRangeDomain2>')"
    d = _grouped_xml(spark, sf, value, f"case when g % 3 = 0 then {ranged} else {coded} end").select("g", documents.domain_definition(F.col("xml")).alias("d"))
    return d.select("g", "d.name", "d.kind", "d.field_type", F.array_join(F.transform("d.codes", lambda c: F.concat(c["code"], F.lit("="), c["label"])), ",").alias("codes"), "d.min", "d.max")
