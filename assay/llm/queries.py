"""One query for each operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontamination, fim, forest, langid, lm, matroska, mixing, ngram_join, quality, sharding, spelling, toxicity, url_filter
from assay.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", *mixing.OUT)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, docs.where(remainder("doc_id", 4) != 2))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *sharding.OUT)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.as_media(_table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), noise=31)


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).select(F.col("doc_id"), *sharding.OUT)


QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_url_filter, op3_language_id, op4_decontamination, op5_quality_classifier, op6_sharding, op7_media_columns, op8_toxicity,
    op9_lm_scoring, op10_ngram_join, op11_spelling_variants, op12_minhash_forest, op13_fill_in_middle, pipeline,
)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, n: int) -> str:
    """SQL: the distinct n-word shingles of each text; a shorter text's whole sequence is one."""
    return f"""select distinct {key}, sh from (select {key}, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from (select {key}, {_WORDS.format("coalesce(text, '')")} as w from {table}))"""


def _op2_sql(levels: int = url_filter.LEVELS) -> str:
    """The tree of url_filter, level by level, as its docstring defines it."""
    head = r"""
with p0 as (select page_id as id, coalesce(url, '') as url from pages),
p1 as (select id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from p0),
p2 as (select id, regexp_extract(rest, '^[^/?#]*', 0) as raw, rest from p1),
p3 as (
    select id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) as path
    from p2),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
    select id, host, path, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as by_rule
    from p3 left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all),
cut as (
    select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
        case when regexp_matches(s, '^([0-9]+(\.[A-Za-z0-9]+)?|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[^/]*-[0-9]{3,})$') then '*' else s end) as whole
    from fits),
"""
    parts = [f"""
seen as (
    select * exclude (whole), case when len(whole) > {levels} then list_append(whole[1:{levels - 1}], array_to_string(whole[{levels}:], '/')) else whole end as segs
    from cut),
paths as (
    select host, segs, count(*) as n, count(by_rule) as labelled, count(*) filter (by_rule = 'block') as bad, [] :: varchar[] as gens, '' as node
    from seen group by host, segs)"""]  # fmt: skip
    last = "paths"
    for k in range(1, levels + 1):
        parts.append(f"""
c{k} as (select host, node, segs[{k}] as seg, sum(n) as c from {last} where len(segs) >= {k} group by all),
w{k} as (
    select host, node, seg from c{k} join (select host, node, sum(c) as total, count(*) as kinds from c{k} group by all) using (host, node)
    where kinds >= 8 and c < 0.1::double * total),
g{k} as (
    select p.host, segs, n, labelled, bad, list_append(gens, gen) as gens, p.node || '/' || gen as node
    from (select p.*, case when w.seg is null then p.segs[{k}] else '*' end as gen
        from {last} p left join w{k} w on w.host = p.host and w.node = p.node and w.seg = p.segs[{k}]) p where len(segs) >= {k}
    union all select * from {last} where len(segs) < {k})""")
        last = f"g{k}"
    parts.append(f"""
named as (select host, segs, gens, n, labelled, bad from {last}),
shapes as (select host, gens, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from named group by all),
rate as (select coalesce(sum(bad)::double / nullif(sum(labelled), 0), 0) as rate from shapes),
hosts as (select host, sum(n) as mn, sum(labelled) as ml, sum(bad) as mb from shapes group by host),
m0 as (select s.*, '' as branch, rate as prior, mn, ml, mb, (mb::double + 10.0::double * rate) / (ml::double + 10.0::double) as purity from shapes s join hosts using (host), rate)""")
    for k in range(1, levels + 1):
        parts.append(f"""
l{k} as (select * replace (prior + (purity - prior) * (ml::double / mn::double) as prior), gens[{k}] as g, coalesce(gens[{k + 1}], '') as nxt from m{k - 1} where len(gens) >= {k}),
cells{k} as (select host, branch, g, nxt, sum(n)::double as o from l{k} group by all),
main{k} as (select host, branch, g, nxt as main from cells{k} qualify row_number() over (partition by host, branch, g order by o desc, nxt desc) = 1),
each{k} as (
    select *, lag(g) over w as prev, lag(n) over w as np, lag(l) over w as lp,
        last_value(case when l > 0 then l end ignore nulls) over v as ll, last_value(case when l > 0 then b end ignore nulls) over v as lb
    from (select *, (b + 10.0::double * p) / (l + 10.0::double) as rate
        from (select host, branch, g, sum(n)::double as n, sum(labelled)::double as l, sum(bad)::double as b, max(prior) as p from l{k} group by all) join main{k} using (host, branch, g))
    window w as (partition by host, branch order by main, rate, g), v as (partition by host, branch order by main, rate, g rows between unbounded preceding and 1 preceding)),
both{k} as (
    select host, branch, g, nxt, sum(og) as og, sum(op) as op, max(a) as a
    from (select e.host, e.branch, e.g, nxt, sqrt(np / n) as a, o as og, 0::double as op from each{k} e join cells{k} c on c.host = e.host and c.branch = e.branch and c.g = e.g where prev is not null
        union all select e.host, e.branch, e.g, nxt, sqrt(np / n), 0, o from each{k} e join cells{k} c on c.host = e.host and c.branch = e.branch and c.g = e.prev) group by host, branch, g, nxt),
shape{k} as (select host, branch, g, sum((og * a - op / a) * (og * a - op / a) / (og + op)) as chi, (count(*) - 1)::double as df from both{k} group by all),
runs{k} as (
    select *, sum(case when alike then 0 else 1 end) over (partition by host, branch order by main, rate, g) as run
    from (select e.*, coalesce(chi <= df + 1.96::double * sqrt(2 * df) + 1e-6::double and ((l > 0) = (lp > 0) or (df > 0 and least(n, np) >= 20)), false) and coalesce(
            pow(b / nullif(l, 0) - lb / ll, 2) <= 1.96::double * 1.96::double * ((b + lb) / (l + ll)) * (1 - (b + lb) / (l + ll)) * (1 / nullif(l, 0) + 1 / ll) + 1e-9::double, true) as alike
        from each{k} e left join shape{k} s on s.host = e.host and s.branch = e.branch and s.g = e.g)),
same{k} as (select host, branch, g, case when count(*) over (partition by host, branch, run) > 1 then '+' || run::bigint else g end as name from runs{k}),
n{k} as (
    select l.* exclude (g, nxt) replace (l.branch || '/' || s.name as branch)
    from l{k} l join same{k} s on s.host = l.host and s.branch = l.branch and s.g = l.g),
b{k} as (select host, branch, sum(n) as bn, sum(labelled) as bl, sum(bad) as bb from n{k} group by all),
m{k} as (
    select n.* replace (bn as mn, bl as ml, bb as mb, (bb::double + 10.0::double * prior) / (bl::double + 10.0::double) as purity) from n{k} n join b{k} using (host, branch)
    union all select * from m{k - 1} where len(gens) < {k})""")
    return head + ",".join(parts).lstrip() + f"""
select s.id as page_id, s.host, s.path, s.rule, coalesce(s.by_rule, case when m.purity >= 0.8::double then 'block' else 'allow' end) as verdict,
    case when m.branch = '' then '/' else m.branch end as template, m.ml::bigint as labelled, m.mb::bigint as bad, m.purity
from seen s join named n on n.host = s.host and n.segs = s.segs join m{levels} m on m.host = n.host and m.gens = n.gens
"""


OP4_SQL = f"""
with d as ({_shingles("documents", "doc_id", 5)}), b as ({_shingles("benchmark", "item_id", 5)}),
size as (select item_id, count(*) as n_item from b group by item_id),
met as (select doc_id, item_id, count(*) as n_shared from d join b using (sh) group by all)
select doc_id, item_id, n_item, n_shared, n_shared::double / n_item as containment from met join size using (item_id) where 5 * n_shared >= 4 * n_item
"""

def _near_sql(words: int, more: str = "") -> str:
    """Components of the documents whose shingles are alike from 85 of 100 on."""
    return f"""
with recursive s as ({_shingles("documents", "doc_id", words)}),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
link as (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
both_ways as (select x, y from link union select y, x from link),
reach(x, y) as (select doc_id, doc_id from n union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id{more} from documents d left join n using (doc_id) left join (select x, min(y) as c from reach group by x) m on m.x = d.doc_id
"""

#: crc32 of a word's bytes, by the table of its polynomial.
OP11_SQL = f"""
with recursive crcs as materialized (select list(c order by k) as t from (select k, list_reduce(list_prepend(k::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(256) r(k))),
runs as (select doc_id, w, count(*) as c from (select doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) as w from documents) group by all),
bytes as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) as x from runs where length(w) >= 7),
hashed as (select w, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::int + 1, 2))::bigint)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) as h from bytes, crcs),
words as materialized (
    select word, sum(c)::bigint as n from (select c, case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from hashed)
    where length(word) >= 7 group by word having sum(c) >= 2),
cut as materialized (select word, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
half as (select a.word as x, b.word as y from cut a join cut b using (i, rest) where a.word <> b.word union select w.word, c.word from words w join cut c on w.word = c.rest),
near as (select x as word, y as near from half union select y, x from half),
best as (select e.word, count(*) as n_near, arg_min(near, (-v.n, near)) as form, max(v.n) as form_n from near e join words v on v.word = e.near group by e.word),
named as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n from words w left join best b using (word)),
path(word, goal) as (select word, word from named union all select p.word, n.form from path p join named n on n.word = p.goal where n.form is not null)
select word, n, n_near, form, form_n, p.goal as root from named join (select p.word, p.goal from path p join named n on n.word = p.goal where n.form is null) p using (word)
"""

OP13_SQL = r"""
with h as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id::varchar) as x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""

SQL = {"op2_url_filter": _op2_sql(), "op4_decontamination": OP4_SQL, "op10_ngram_join": _near_sql(4), "op11_spelling_variants": OP11_SQL, "op12_minhash_forest": _near_sql(3, ", coalesce(m.c, d.doc_id) = d.doc_id as kept"), "op13_fill_in_middle": OP13_SQL}
