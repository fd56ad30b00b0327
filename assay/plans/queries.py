"""The operators applied to the driver's tables, over all rows, each with the SQL that gives the same result.

The tables have few natural defects, so queries plant some by expressions that
both engines understand (``PLANTED``); the operators then run on every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import scoring, text
from assay.operators import completeness, dates, domains, evaluate, lineage, references, trust, uniqueness
from assay.sources import dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark", "embeddings")
AS_OF = datetime(2001, 6, 1)

_N, _K, _KINDS = "cast(c_nationkey as string)", "(c_custkey % 41)", "case when c_nationkey % 3 = 0 then 'point' else 'line' end"
_TYPES = f"case ({_K} + c_nationkey) % 4 when 0 then 'String' when 1 then 'Integer' when 2 then 'Double' else 'Date' end"

#: Tables with planted defects, as expressions over one driver table.
PLANTED = {
    "p_customer": ("customer", "c_custkey as fid, c_name as name, case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then '  ' when c_custkey % 13 = 0 then 'None' when c_custkey % 17 = 0 then 'nan' else c_mktsegment end as segment, case when c_custkey % 10 = 0 then null when c_custkey % 19 = 0 then cast('NaN' as double) else c_acctbal end as balance, case when c_custkey % 23 = 0 then null else concat('{', lower(c_name), '}') end as globalid"),
    "p_orders": ("orders", "o_orderkey as fid, case when o_orderkey % 9 = 0 then null when o_orderkey % 5 = 0 then concat(' ', o_orderpriority, ' ') else o_orderpriority end as priority, case when o_orderkey % 8 = 0 then '' else o_orderstatus end as status, o_orderdate as ordered, o_totalprice as price"),
    "p_part": ("part", "p_partkey as fid, case when p_partkey % 9 = 0 then concat('x', cast(p_size as string)) when p_partkey % 4 = 0 then concat(cast(p_size as string), '.0') when p_partkey % 14 = 0 then '' else cast(p_size as string) end as size_text, case when p_partkey % 12 = 0 then null else p_brand end as brand, case when p_partkey % 15 = 0 then null when p_partkey % 6 = 0 then lower(p_type) else p_type end as kind, p_name as name"),
    # a catalog with a class for each nation and up to 41 fields in each, its reference model, and the layers' coordinate systems
    "p_source": ("customer", f"distinct concat('Class', {_N}) as class, {_KINDS} as kind, case {_K} when 0 then 'ASSETID' when 1 then 'AssetGroup' when 2 then case when c_nationkey % 4 = 0 then 'Author' else 'Creator' end when 3 then 'Shape' else concat('Field', cast({_K} as string)) end as field, case {_K} when 1 then 'Integer' when 3 then 'Geometry' else {_TYPES} end as type, case when {_K} % 5 = 0 then concat('Dom', cast({_K} as string)) end as domain, {_K} % 3 <> 0 as nullable, {_K} % 7 = 0 as required"),
    "p_model": ("customer", f"distinct case when c_nationkey % 8 = 7 then concat('other', {_N}) else concat('class', {_N}) end as class, {_KINDS} as kind, case {_K} when 0 then 'assetid' when 1 then 'assetgroup' when 2 then 'created_user' when 3 then 'shape' else concat(case when {_K} % 6 = 0 then 'new' else 'field' end, cast({_K} as string)) end as field, case {_K} when 1 then 'Integer' when 3 then 'Geometry' when 8 then 'Double' else {_TYPES} end as type, case when {_K} % 4 = 0 then concat('dom', cast({_K} as string)) end as domain, {_K} % 4 <> 1 as nullable, {_K} % 9 = 0 as required"),
    "p_pairs": ("customer", "distinct concat('Class', cast(case when c_nationkey % 8 = 7 then 0 else c_nationkey end as string)) as class, concat('class', cast(case when c_nationkey % 8 = 7 then 0 else c_nationkey end as string)) as counterpart"),
    "p_models": ("customer", f"distinct case c_nationkey % 6 when 0 then 'water essential' when 1 then 'sewer balanced' when 2 then 'gas' when 3 then 'my water' when 4 then 'electric advanced' else 'telecom' end as model, concat('class', {_N}) as class, concat('field', cast({_K} as string)) as field"),
    "p_domain": ("part", "distinct concat('Dom', cast(p_size as string)) as name, case p_size % 4 when 0 then 'esriFieldTypeSmallInteger' when 1 then 'esriFieldTypeString' when 2 then 'esriFieldTypeDouble' else 'esriFieldTypeDate' end as field_type"),
    "p_systems": ("customer", "c_name as layer, case when c_custkey % 7 = 0 then null else concat('zone ', cast(c_nationkey % 3 as string)) end as horizontal, case when c_custkey % 5 = 0 then null else 'NAVD88' end as vertical, c_custkey % 2 = 0 as has_z, case when c_custkey % 7 = 0 then null else c_nationkey % 3 = 1 end as geographic, c_custkey as pos"),
    "p_label": ("customer", f"c_custkey as id, case c_custkey % 18 when 0 then concat('GDB_', c_name) when 1 then concat('UN_', {_N}, '_Associations') when 2 then concat('un_temp_', c_name) when 3 then concat('B_', c_mktsegment) when 4 then '_Version' when 5 then concat(c_name, '__ATTACH') when 6 then concat('T_', {_N}, '_Dirty') when 7 then concat('N_', {_N}, '_X') when 8 then 'view_UN_5' when 9 then concat('gpkg_', c_name) when 10 then 'rtree_a' when 11 then 'sqlite_seq' when 12 then 'xGDB_' when 13 then concat('UN_x_', {_N}) when 14 then '_Versions' else c_name end as name"),
    "p_hollow": ("documents", "doc_id, case doc_id % 14 when 0 then concat('REQUIRED: ', text) when 1 then ' none ' when 2 then 'N/A' when 3 then 'na' when 4 then 'nothing' when 5 then 'tbd' when 6 then concat('There is no description for ', lang) when 7 then concat('none of ', text) when 8 then null when 9 then '' else text end as t"),
    "p_topic": ("part", "p_partkey as id, case p_partkey % 13 when 0 then null when 1 then concat(p_name, ' Stormwater') when 2 then concat('wastewater ', p_type) when 3 then concat('Sanitary ', p_name) when 4 then concat('Water Distribution ', p_brand) when 5 then concat('rain water sewer ', p_name) when 6 then concat('Electric ', p_type) when 7 then 'Gas pipeline' when 8 then concat(p_brand, ' fiber') when 9 then 'District Energy' else p_name end as t"),
    "p_cell": ("customer", "c_custkey as id, case c_custkey % 12 when 0 then concat('=', c_name) when 1 then concat('-', cast(c_custkey as string)) when 2 then concat('-', c_name) when 3 then concat('+', cast(c_custkey as string), '.5e2') when 4 then concat('@', c_mktsegment) when 5 then null when 6 then '' when 7 then '-inf' when 8 then concat('+1_0', cast(c_custkey as string)) when 9 then '=' when 10 then cast(c_custkey as string) else c_name end as c"),
    "p_wkt": ("customer", f"""c_custkey as id, case when c_custkey % 4 = 0 then concat('GEOGCS["geo ', c_name, '",DATUM["d', {_N}, '",SPHEROID["s",6378137,298.25]],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","', cast(4000 + c_nationkey as string), '"]]')
        when c_custkey % 4 = 1 then concat('PROJCS["zone ', {_N}, '",GEOGCS["g",DATUM["d', {_N}, '"],UNIT["degree",0.0174532925199433]],UNIT["metre",1],AUTHORITY["EPSG","', cast(26900 + c_nationkey as string), '"]]')
        when c_custkey % 4 = 2 then concat('COMPD_CS["both ', c_name, '",PROJCS["zone ', {_N}, '",GEOGCS["g",DATUM["d1"],UNIT["degree",0.01745]],UNIT["foot",0.3048]],VERT_CS["height ', {_N}, '",VERT_DATUM["v",2005],UNIT["metre",1]]]')
        when c_custkey % 12 = 3 then '' when c_custkey % 12 = 7 then null else c_name end as wkt, c_custkey % 4 as kind, c_name, {_N} as nation, c_nationkey"""),
    "p_emitted": ("orders", "o_orderkey, case o_orderkey % 5 when 0 then 'null_required' when 1 then 'null_optional' when 2 then 'duplicate_globalid' when 3 then 'coded_value' else 'unknown_rule' end as key"),
}


def planted(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table, select = PLANTED[name]
    read(spark, sf, table).createOrReplaceTempView(f"assay_{table}")
    return spark.sql(f"select {select} from assay_{table}")


def with_planted(sql: str) -> str:
    """sql with the planted tables that it names."""
    used = [f"{n} as (select {select} from {table})" for n, (table, select) in PLANTED.items() if re.search(rf"\b{n}\b", sql)]
    return f"with {', '.join(used)} select * from ({sql})" if used else sql


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = with_planted(sql)
        return fn

    return put


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], alias: str) -> str:
    """An inline table as SQL."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as {alias}"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NUM = r"regexp_matches({0}, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$')"
_BLANK = "({0} is null or " + _TRIM.format("{0}") + " in ('', 'None', 'nan'))"
_NAN = "({0} is null or isnan({0}))"
_GUID = "trim(" + _TRIM.format("upper({})") + ", '{{}}')"


def num(c: str) -> str:
    return f"case when {_NUM.format(c)} then try_cast(trim({c}) as double) end"


# ---- inventory and catalog ------------------------------------------------------------------------


@query(" union all ".join(f"select '{t}' as layer, (select count(*) from {t}) as rows, (select count(*) from (describe {t})) as fields, true as readable, false as system" for t in TABLES))
def inventory_layers(spark, sf):
    return dataset.Dataset.open(spark, sf, TABLES).layers()


@query("select 14::bigint as layers, 0::bigint as system_tables, 0::bigint as empty, 0::bigint as unreadable, sum(n)::bigint as rows, sum(f)::bigint as fields from (" + " union all ".join(f"select (select count(*) from {t}) as n, (select count(*) from (describe {t})) as f" for t in TABLES) + ")")
def inventory_summary(spark, sf):
    return dataset.summary(dataset.Dataset.open(spark, sf, TABLES).layers())




@query("select id, name, regexp_matches(name, '^GDB_|^UN_\\d+_|^UN_Temp|^[ABC]_|^_Version$|__ATTACH$|^T_\\d+_|^N_\\d+_|^view_UN_|^gpkg_|^rtree_|^sqlite_', 'i') as system from p_label")
def inventory_system_tables(spark, sf):
    return planted(spark, sf, "p_label").withColumn("system", text.is_system(F.col("name")))


_KIND = "concat('type-', case when n_nationkey % 7 = 3 then 'unknown' else cast(n_regionkey as string) end)"


@query(f"""select concat('main.', n_name) as name, n_name as short_name, coalesce(r_name, kind) as kind
from (select *, {_KIND} as kind from nation) left join region on concat('type-', cast(r_regionkey as string)) = kind""")
def catalog_items(spark, sf):
    items = read(spark, sf, "nation").selectExpr("concat('main.', n_name) as name", f"{_KIND} as type")
    types = read(spark, sf, "region").selectExpr("concat('type-', cast(r_regionkey as string)) as uuid", "r_name as label")
    return dataset.catalog_items(items, types)


REGISTERED = [("Customer", False, True), ("view_orders", False, False), ("archive", True, True), ("lost", False, False), ("broken", False, True), ("GDB_Items", False, False), ("LINEITEM", False, True), (None, False, False)]


@query(f"""select name, case when lower(name) like 'view\\_%' escape '\\' or cdf then 'info' else 'error' end as severity, case when lower(name) like 'view\\_%' escape '\\' then 'view' when cdf then 'compressed' when not tab then 'table file missing' else 'could not be opened' end as reason
from {values(REGISTERED, 'r(name, cdf, tab)')} where name is not null and not starts_with(upper(name), 'GDB_') and lower(name) not in ({', '.join(f"'{t}'" for t in TABLES)})""")
def catalog_missing(spark, sf):
    return dataset.missing_tables(inline(spark, "name string, has_cdf boolean, has_table boolean", REGISTERED), dataset.Dataset.open(spark, sf, TABLES).layers())


@query("""with p as (select list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[^/]*//', ''), '/'), lambda s: s <> '') as p from pages),
a as (select array_to_string(p[1:k], '/') as folder from (select p, unnest(range(1, len(p))) as k from p where len(p) > 1)), n as (select folder, count(*) as n from a group by 1 having count(*) >= 2)
select folder, n from n where not exists (select 1 from n u where strpos(n.folder, '/') > 0 and u.folder = regexp_replace(n.folder, '/[^/]*$', '') and u.n = n.n)""")
def folder_rollup(spark, sf):
    paths = read(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[^/]*//", "").alias("path"))
    return dataset.folder_rollup(paths)


IDS = [(7, 0), (3, 1), (99, 2), (3, 3), (-1, 4), (0, 5)]


@query(f"select c_custkey, c_name, pos from customer join {values(IDS, 'i(id, pos)')} on id = c_custkey")
def read_fids_ordered(spark, sf):
    ids = F.broadcast(inline(spark, "id long, pos int", IDS))
    return dataset.read_ids(read(spark, sf, "customer"), ids, "c_custkey").select("c_custkey", "c_name", "pos")


# ---- completeness ---------------------------------------------------------------------------------



@query(f"""select distinct layer, name, lower(name) in ('globalid', 'assetgroup', 'assettype') as configured, coalesce(nullable, true) as nullable from (select class as layer, field as name, type, nullable, required from p_source)
where lower(name) in ('globalid', 'assetgroup', 'assettype') or ((not coalesce(nullable, true) or coalesce(required, false)) and not (regexp_matches(type, 'OID|Geometry', 'i') or lower(name) in ('created_user', 'creator') or starts_with(lower(name), 'shape')))""")
def required_fields_selected(spark, sf):
    return completeness.required_fields(planted(spark, sf, "p_source").select(F.col("class").alias("layer"), F.col("field").alias("name"), "type", "nullable", "required"))


_COLS = [("p_customer", "segment", _BLANK), ("p_customer", "balance", _NAN), ("p_customer", "name", _BLANK), ("p_customer", "globalid", _BLANK), ("p_orders", "priority", _BLANK), ("p_orders", "status", _BLANK)]
_NULLS = " union all ".join(f"select '{t[2:]}' as layer, '{c}' as field, count(*) as rows, count(*) filter ({b.format(c)}) as empty from {t}" for t, c, b in _COLS)


@query(f"select * from ({_NULLS})")
def required_nulls(spark, sf):
    parts = [completeness.blank_counts(planted(spark, sf, t), [c for n, c, _ in _COLS if n == t]).withColumn("layer", F.lit(t[2:])) for t in ("p_customer", "p_orders")]
    return trust.union(*parts)


@query(f"select layer, field, empty, case when upper(field) = 'GLOBALID' then 'critical' when field in ('segment', 'status') then 'error' else 'warning' end as severity from ({_NULLS}) where empty > 0")
def required_nulls_severity(spark, sf):
    sev = completeness.severity_of(F.col("field"), F.col("field") == "segment", F.col("field") != "status")
    return required_nulls(spark, sf).where("empty > 0").select("layer", "field", "empty", sev.alias("severity"))


@query(f"select fid from p_customer where {_BLANK.format('segment')} or {_NAN.format('balance')}")
def null_any_row(spark, sf):
    return completeness.blank_rows(planted(spark, sf, "p_customer"), ["segment", "balance"]).select("fid")


# ---- uniqueness -----------------------------------------------------------------------------------

_LI = "select l_orderkey, l_linenumber, count(*) as members from lineitem group by all having count(*) > 1"


@query(f"select count(*) as groups, coalesce(sum(members), 0)::bigint as members from ({_LI})")
def dup_within_class(spark, sf):
    return uniqueness.repeated_summary(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from ({_LI}))")
def dup_rows(spark, sf):
    return uniqueness.repeated_rows(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query("select p_name as value, count(*) as n from part group by 1 having count(*) > 1 order by 2 desc, 1 limit 5")
def dup_top_values(spark, sf):
    return uniqueness.top_values(read(spark, sf, "part"), "p_name")


_NORM = "md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')))"


@query(f"select count(*) as groups, coalesce(sum(n), 0)::bigint as members from (select count(*) as n from documents group by {_NORM} having count(*) > 1)")
def dup_text_exact(spark, sf):
    return uniqueness.repeated_summary(read(spark, sf, "documents").select(F.md5(F.trim(F.regexp_replace(F.lower("text"), "[ \t\n\r]+", " "))).alias("h")), ["h"])


_VAR = "case when s_suppkey % 3 = 0 then concat('{', lower(s_name), '}') when s_suppkey % 3 = 1 then concat('  ', s_name, ' ') else s_name end"


@query(f"select s_suppkey, {_GUID.format(_VAR)} as gid from supplier")
def guid_normalize(spark, sf):
    return read(spark, sf, "supplier").selectExpr("s_suppkey", f"{_VAR} as raw").select("s_suppkey", text.guid(F.col("raw")).alias("gid"))


_STACK = "select 'customer' as layer, c_custkey as gid from customer union all select 'supplier', s_suppkey from supplier union all select 'part', p_partkey from part"


@query(f"select cast(gid as string) as gid, count(*) as rows, string_agg(distinct layer, ',' order by layer) as layers from ({_STACK}) group by 1 having count(distinct layer) > 1")
def cross_class_ids(spark, sf):
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    return uniqueness.across_layers(uniqueness.stack_ids({t: (read(spark, sf, t), c) for t, c in keys.items()}))


@query(" union all ".join(f"select '{t}' as layer, (select count(*) from {t}) as rows" for t in TABLES if t not in ("documents", "labels")))
def missing_id_field(spark, sf):
    d = dataset.Dataset.open(spark, sf, TABLES)
    having = d.fields().where(F.lower("field") == "doc_id").select("layer")
    return d.layers().join(having, "layer", "left_anti").select("layer", "rows")


@query(f"""select bad, total, greatest(0.0::double, 100.0 - 10.0 * 100.0 * (bad / total)) as score from (select (select coalesce(sum(members), 0) from ({_LI}))::double + 0.25 * (select coalesce(sum(n), 0) from (select count(*) as n from part group by p_name having count(*) > 1))::double as bad,
((select count(*) from lineitem) + (select count(*) from part))::double as total)""")
def id_uniqueness_score(spark, sf):
    li, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    one = uniqueness.repeated_summary(li, ["l_orderkey", "l_linenumber"]).select(F.col("members").cast("double").alias("bad")).crossJoin(F.broadcast(li.agg(F.count("*").alias("n"))))
    two = uniqueness.repeated_summary(part, ["p_name"]).select((0.25 * F.col("members")).alias("bad")).crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))
    both = one.unionByName(two).agg(F.sum("bad").alias("bad"), F.sum("n").cast("double").alias("total"))
    return both.select("bad", "total", scoring.penalty(F.col("bad"), F.col("total")).alias("score"))


@query(f"select status, string_agg(cast(fid as string), ',' order by fid) as ids from (select status, fid, row_number() over (partition by status order by fid) as r from p_orders where {_BLANK.format('priority')}) where r <= 25 group by 1")
def sample_ids(spark, sf):
    return uniqueness.first_ids(completeness.blank_rows(planted(spark, sf, "p_orders"), ["priority"]), ["status"], "fid")


# ---- domains --------------------------------------------------------------------------------------

CODES = [("priority", "1-URGENT"), ("priority", " 2-HIGH "), ("priority", "3-MEDIUM")]
_TEXT = f"select fid as id, priority as value, 'priority' as domain from p_orders where priority is not null and {_TRIM.format('priority')} not in ('', '1-URGENT', '2-HIGH', '3-MEDIUM'{{}})"


@query(_TEXT.format(""))
def domain_coded_text(spark, sf, extra=()):
    values_ = domains.assigned(planted(spark, sf, "p_orders"), "fid", "priority", F.lit("priority"))
    return domains.coded_violations(values_, inline(spark, "domain string, code string", [*CODES, *extra]))


@query(_TEXT.format(", '5-LOW'"))
def domain_extra_codes(spark, sf):
    return domain_coded_text(spark, sf, [("priority", "5-LOW")])


@query(f"select fid as id, size_text as value, 'size' as domain from p_part where coalesce({num('size_text')}, -1) not in (select range from range(1, 26))")
def domain_coded_numeric(spark, sf):
    codes = spark.range(1, 26).select(F.lit("size").alias("domain"), F.col("id").cast("string").alias("code")).unionByName(inline(spark, "domain string, code string", [("size", "ignored")]))
    return domains.coded_violations(domains.assigned(planted(spark, sf, "p_part"), "fid", "size_text", F.lit("size")), codes)


RANGES = [("quantity", 2.0, 45.0), ("discount", None, 0.08), ("tax", 0.02, None)]


@query("select 'quantity' as domain, count(*) as n from lineitem where l_quantity < 2 or l_quantity > 45 union all select 'discount', count(*) from lineitem where l_discount > 0.08 union all select 'tax', count(*) from lineitem where l_tax < 0.02")
def domain_range(spark, sf):
    li = read(spark, sf, "lineitem")
    stacked = trust.union(*[domains.assigned(li, "l_orderkey", f"l_{d}", F.lit(d)) for d, _, _ in RANGES])
    return domains.range_violations(stacked, inline(spark, "domain string, min double, max double", RANGES)).groupBy("domain").agg(F.count("*").alias("n"))


_EVALUATED = {
    "brand": "brand is null", "size of every third": "fid % 3 = 0 and (try_cast(size_text as double) is null or try_cast(size_text as double) not in (1, 2, 3, 5, 8, 13, 21, 34))",
    "kind": "kind is not null and trim(kind) <> '' and kind <> upper(kind)",
}


def _evaluated_sql() -> str:
    """For each test: counts, the first 25 ids and the six most frequent values."""
    shown = {"brand": "null", "size of every third": "size_text", "kind": "kind"}
    counts = {"brand": "true", "size of every third": "fid % 3 = 0 and size_text is not null", "kind": "kind is not null"}
    parts = []
    for name, bad in _EVALUATED.items():
        bad = f"coalesce({bad}, false) and {counts[name]}"
        top = f"(select string_agg(v || '=' || n, ',' order by n desc, v) from (select {shown[name]} as v, count(*) as n from p_part where {bad} group by 1 order by n desc, v limit 6))" if name != "brand" else "null"
        parts.append(f"select '{name}' as test, count(*) filter ({bad}) as bad, count(*) filter ({counts[name]}) as counted, (select string_agg(fid, ',' order by fid) from (select fid from p_part where {bad} order by fid limit 25)) as ids, {top} as top from p_part")
    return " union all ".join(parts)


@query(_evaluated_sql())
def layer_evaluated(spark, sf):
    df = planted(spark, sf, "p_part")
    size, kind, third = F.col("size_text"), F.col("kind"), F.col("fid") % 3 == 0
    tests = [
        evaluate.RowTest("brand", completeness.blanks(df, ["brand"])["brand"]),
        evaluate.RowTest("size of every third", third & size.isNotNull() & domains.breaks_codes(size, ["1", "2", "3", "5", "8", "13", "21", "34"], True), third & size.isNotNull(), size),
        evaluate.RowTest("kind", kind.isNotNull() & (kind != F.upper(kind)), kind.isNotNull(), kind),
    ]
    row = evaluate.counted(df, tests)
    counts = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t.name).alias("test"), F.col(f"b{i}").alias("bad"), F.col(f"n{i}").alias("counted")) for i, t in enumerate(tests)])).alias("c")).select("c.*")
    found = evaluate.samples(df, "fid", tests, 25).withColumnRenamed("test", "k")
    lists = found.groupBy("k").agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.struct("rank", F.concat_ws("=", "value", F.col("rows").cast("string")).alias("t"))))).alias("top")
    )
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    lists = lists.select("k", text(F.transform("ids", lambda x: x.cast("string"))).alias("ids"), text(F.transform("top", lambda t: t["t"])).alias("top"))
    return counts.join(lists, "k", "left").drop("k")


@query("""with u as (select 'customer' as layer, 'key' as field, cast(c_custkey as varchar) as key from customer union all select 'customer', 'segment', c_mktsegment from customer
    union all select 'orders', 'key', cast(o_custkey as varchar) from orders union all select 'orders', 'segment', o_orderpriority from orders union all select 'supplier', 'key', cast(s_suppkey as varchar) from supplier),
p as (select field, key, layer, count(*) as n, count(*) over (partition by field, key) as k from u where key is not null and key <> '' group by field, key, layer)
select layer, field, sum(n)::bigint as filled, coalesce(sum(n) filter (n > 1), 0)::bigint as members, coalesce(sum(n) filter (k > 1), 0)::bigint as shared from p group by all""")
def id_usage(spark, sf):
    c, o, s = (read(spark, sf, t) for t in ("customer", "orders", "supplier"))
    return uniqueness.id_usage({
        "customer": (c, [("key", F.col("c_custkey")), ("segment", F.col("c_mktsegment"))]), "orders": (o, [("key", F.col("o_custkey")), ("segment", F.col("o_orderpriority"))]), "supplier": (s, [("key", F.col("s_suppkey"))]),
    })


@query("""with e as (select event_id as id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events)
select 'click_value' as domain, count(*) as n from e where event_type = 'click' and (value < 0 or value > 20) union all select 'any_value', count(*) from e where event_type not in ('click', 'error') and (value < 1 or value > 60)
union all select 'error_k', count(*) from e where event_type = 'error' and k not in (select range * 2 from range(0, 50))""")
def domain_subtype(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    by_type = F.when(F.col("event_type") == "click", "click_value").when(F.col("event_type") != "error", "any_value")
    ranged = domains.range_violations(domains.assigned(e, "event_id", "value", by_type), inline(spark, "domain string, min double, max double", [("click_value", 0.0, 20.0), ("any_value", 1.0, 60.0)]))
    codes = spark.range(0, 50).select(F.lit("error_k").alias("domain"), (F.col("id") * 2).cast("string").alias("code"))
    coded = domains.coded_violations(domains.assigned(e, "event_id", "k", F.when(F.col("event_type") == "error", "error_k")), codes)
    return ranged.unionByName(coded).groupBy("domain").agg(F.count("*").alias("n"))


@query(f"select domain, value, n, cast(r as int) as rank from (select domain, value, n, row_number() over (partition by domain order by n desc, value) as r from (select domain, value, count(*) as n from ({_TEXT.format('')}) group by all)) where r <= 6")
def domain_violation_top(spark, sf):
    return domains.top_violations(domain_coded_text(spark, sf))


@query(f"select bad, total, greatest(0.0::double, 100.0 - 10.0 * 100.0 * (bad::double / total::double)) as score from (select (select count(*) from ({_TEXT.format('')})) as bad, (select count(priority) from p_orders) as total)")
def domain_validity_score(spark, sf):
    bad = domain_coded_text(spark, sf).agg(F.count("*").alias("bad"))
    total = planted(spark, sf, "p_orders").agg(F.count("priority").alias("total"))
    return bad.crossJoin(F.broadcast(total)).select("bad", "total", scoring.penalty(F.col("bad"), F.col("total")).alias("score"))


_R, _D = "(select class as layer, field, type, domain from p_source) r", "p_domain d"
_FAMILY = "case when regexp_matches(lower({0}), 'integer|int16|int32|int64') then 'int' when regexp_matches(lower({0}), 'double|single|float|real') then 'float' when regexp_matches(lower({0}), 'date|time') then 'date' when regexp_matches(lower({0}), 'guid|globalid') then 'guid' when regexp_matches(lower({0}), 'str|object') then 'text' else lower({0}) end"


def _references(spark, sf):
    return planted(spark, sf, "p_source").withColumnRenamed("class", "layer")


@query(f"""select layer, field, domain, 'missing' as problem from {_R} where domain is not null and domain not in (select name from {_D})
union all select layer, field, domain, 'mismatch' from (select layer, field, domain, {_FAMILY.format('type')} as a, {_FAMILY.format('field_type')} as b from {_R} join {_D} on domain = name) where a <> b and not (a in ('int', 'float') and b in ('int', 'float'))""")
def domain_integrity(spark, sf):
    refs, doms = _references(spark, sf), planted(spark, sf, "p_domain")
    cols = ["layer", "field", "domain"]
    return domains.missing_domains(refs, doms).withColumn("problem", F.lit("missing")).unionByName(domains.mismatched_domains(refs, doms).select(*cols).withColumn("problem", F.lit("mismatch")))


@query(f"select name from {_D} where name not in (select domain from {_R} where domain is not null)")
def domain_unused(spark, sf):
    return domains.unused_domains(_references(spark, sf), planted(spark, sf, "p_domain"))


# ---- references and system tables -----------------------------------------------------------------


#: Ends of an association with planted defects: ids that no part or supplier has, and nulls.
_ENDS = """case when l_orderkey % 50 = 7 then 'p0' when l_orderkey % 64 = 9 then null else concat('p', cast(l_partkey as string)) end as from_id,
case when l_linenumber = 5 and l_orderkey % 9 = 2 then '{s-1}' else concat('{s', cast(l_suppkey as string), '}') end as to_id"""
_ORPHANS = f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, {_ENDS} from lineitem)
where from_id is null or upper(from_id) not in (select concat('P', cast(p_partkey as string)) from part) or upper(trim(to_id, '{{}}')) not in (select concat('S', cast(s_suppkey as string)) from supplier)"""


@query(_ORPHANS)
def assoc_orphans(spark, sf):
    known = read(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id")).unionByName(read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")))
    ends = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_ENDS.split(",\n"))
    return references.orphans(ends, ["from_id", "to_id"], references.known_ids((known, "id"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def assoc_orphans_single(spark, sf):
    return references.orphans(read(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], references.known_ids((read(spark, sf, "labels"), "doc_id")))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def assoc_types(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select dirty, total, least(20.0::double, 100.0 * dirty / total) as deduction from (select count(*) filter (o_orderstatus = 'P') as dirty, count(*) as total from orders)")
def dirty_ratio(spark, sf):
    flag = read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "1").otherwise("0").alias("isdirty"))
    n = flag.agg(F.count_if(text.number(F.col("isdirty")) == 1).alias("dirty"), F.count("*").alias("total"))
    return n.select("dirty", "total", F.least(F.lit(20.0), F.try_divide(100.0 * F.col("dirty"), F.col("total"))).alias("deduction"))


@query(f"""with o as (select count(*) as n from ({_ORPHANS})), t as (select count(*) as n from lineitem), d as (select count(*) filter (o_orderstatus = 'P') as n, count(*) as t from orders)
select o.n as orphans, t.n as associations, d.n as dirty, 100.0::double - least(30.0::double, 300.0 * o.n / t.n) - least(20.0::double, 100.0 * d.n / d.t) as score from o, t, d""")
def un_tables_counts(spark, sf):
    a = assoc_orphans(spark, sf).agg(F.count("*").alias("orphans"))
    b = read(spark, sf, "lineitem").agg(F.count("*").alias("associations"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(dirty_ratio(spark, sf)))  # one row each
    return one.select("orphans", "associations", "dirty", (100.0 - F.least(F.lit(30.0), F.try_divide(300.0 * F.col("orphans"), F.col("associations"))) - F.col("deduction")).alias("score"))


STATUS = [("P", "Not connected"), ("F", "Connected"), ("O", "Disconnected by crew")]


@query("select bad, total, greatest(0.0::double, 100.0 - 3.0 * 100.0 * (bad::double / total::double)) as score from (select count(*) filter (o_orderstatus in ('P', 'O')) as bad, count(*) as total from orders)")
def isconnected(spark, sf):
    labels = inline(spark, "code string, label string", STATUS).where(F.col("label").rlike("(?i)disconnect|not connected"))
    o = read(spark, sf, "orders")
    bad = o.join(F.broadcast(labels), o["o_orderstatus"] == labels["code"], "left_semi").agg(F.count("*").alias("bad"))
    return bad.crossJoin(F.broadcast(o.agg(F.count("*").alias("total")))).select("bad", "total", scoring.penalty(F.col("bad"), F.col("total"), 3.0).alias("score"))


# ---- dates ----------------------------------------------------------------------------------------

_LATE = "timestamp '2001-06-02 00:00:00'"


def _dates(table: str, col: str, floor: str) -> str:
    return f"select '{col}' as field, count({col}) as dated, count(*) filter ({col} > {_LATE}) as future, strftime(max({col}) filter ({col} > {_LATE}), '%Y-%m-%d') as latest, count(*) filter ({col} < timestamp '{floor}') as old, strftime(min({col}) filter ({col} < timestamp '{floor}'), '%Y-%m-%d') as earliest from {table}"


@query(_dates("orders", "o_orderdate", "1995-03-01") + " union all " + _dates("lineitem", "l_shipdate", "1995-03-01"))
def date_sanity(spark, sf):
    floor = datetime(1995, 3, 1)
    both = dates.date_sanity(read(spark, sf, "orders"), ["o_orderdate"], AS_OF, floor).unionByName(dates.date_sanity(read(spark, sf, "lineitem"), ["l_shipdate"], AS_OF, floor))
    return both.withColumns({"latest": F.date_format("latest", "yyyy-MM-dd"), "earliest": F.date_format("earliest", "yyyy-MM-dd")})


_DIRTY = "case when o_orderkey % 6 = 0 then concat(' ', substr(cast(o_orderdate as string), 1, 10), ' ') when o_orderkey % 6 = 1 then 'garbage' when o_orderkey % 6 = 2 then '9999-12-31' when o_orderkey % 6 = 3 then '1700-05-01 10:00:00' when o_orderkey % 6 = 4 then concat(substr(cast(o_orderdate as string), 1, 10), ' 08:30:00 some text') else null end"


@query(f"select o_orderkey, strftime(coalesce(try_cast(t as timestamp), try_cast(substr(replace(t, ' ', 'T'), 1, 19) as timestamp)), '%Y-%m-%d %H:%M:%S') as parsed from (select o_orderkey, {_TRIM.format(_DIRTY)} as t from orders)")
def date_parse(spark, sf):
    return read(spark, sf, "orders").selectExpr("o_orderkey", f"{_DIRTY} as raw").select("o_orderkey", F.date_format(text.parse_dates(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("select count(*) as shipped_early, strftime(min(l_shipdate), '%Y-%m-%d') as first from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate")
def date_cross_field(spark, sf):
    li, o = read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").agg(F.count("*").alias("shipped_early"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first"))


@query("select strftime(min(a), '%Y-%m-%d') as first, strftime(max(b), '%Y-%m-%d') as last from (select min(o_orderdate) as a, max(o_orderdate) as b from orders union all select min(l_shipdate), max(l_shipdate) from lineitem union all select min(ts), max(ts) from events)")
def edit_span(spark, sf):
    s = dates.span([(read(spark, sf, t), [c]) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))])
    return s.select(F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))




@query("select class as layer, bool_or(lower(field) in ('created_user', 'creator', 'editdate', 'updatedby')) as tracked from p_source group by 1")
def edit_tracking_coverage(spark, sf):
    return lineage.tracking_coverage(_references(spark, sf))
