"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import decontamination, langid, lm, matroska, mixing, ngram_join, quality, sharding, tokens, toxicity, url_filter
from assay.llm.common import components
from assay.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, size int, SCORE string, shard string"


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [_prose(rng, rng.randint(3, 120), words) for _ in range(60)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
        if i % 3 == 0:  # near copies
            w = t.split()
            for k in range(3):
                v = list(w)
                v[rng.randrange(len(v))] = f"edit{k}"
                rows.append((1000 + 10 * i + k, " ".join(v)))
        if i % 5 == 0:
            rows.append((2000 + i, t.upper()))
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one two"), (3004, "one two"), (3005, " ".join(words * 60)), (None, base[0]), (None, None), (3, base[3])]
    return [(i, t, ["en", "fr", None][n % 3], ["a", "b", None][min(2, n % 7)], 1, "x", "y") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def _set(t, n):
    w = _words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_words_and_shingles():
    texts = ["A b\u00a0c  D", None, "", " x", "\u00c9t\u00e9 \x0b\x1fq", "a b c d e"]
    for most in (1, 1 << 20):
        seen, sizes = {}, []
        for c in tokens.chunks(pa.array(texts), most):
            w = tokens.words(c)
            for i in range(c.n):
                h = w.hash[w.first[i] : w.first[i + 1]].tolist()
                expected = _words(texts[c.first + i])
                assert len(h) == len(expected)
                for x, y in zip(expected, h, strict=True):
                    assert seen.setdefault(x, y) == y
            sizes += [len(s) for s in tokens.shingle_sets(w, 4)]
        assert sizes == [len(_set(t, 4)) for t in texts]
        assert len(set(seen.values())) == len(seen)


def _components(sets):
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[find(x)] = find(y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(spark, docs, corpus, empty, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = {(n, r[0]): _set(r[1], 4) for n, r in enumerate(corpus)}
    root = _components(sets)
    least = {}
    for (n, i), r in root.items():
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, len(sets[(n, i)]), least.get(root[(n, i)]) if sets[(n, i)] else i) for n, i in sets)
    got = Counter(map(tuple, ngram_join.ngram_join(docs).collect()))
    assert got == want
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_boundary(spark):
    """Pairs just at and just below the threshold, many sizes, against brute force."""
    rng = random.Random(9)
    rows, i = [], 0
    for n in (6, 7, 12, 23, 24, 40, 47, 48, 95, 96, 200):
        base = [f"w{rng.random()}" for _ in range(n + 3)]
        for cut in range(0, max(2, n // 5), max(1, n // 40)):
            rows.append((i, " ".join(base[cut:])))
            i += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    root = _components({k: _set(t, 4) for k, t in rows})
    least = defaultdict(lambda: 10**9)
    for k, r in root.items():
        least[r] = min(least[r], k)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame).collect()} == {k: least[r] for k, r in root.items()}


def test_ngram_join_takes_a_crowded_tile_by_prefixes(spark, monkeypatch):
    """5,000 texts share a third of their shingles and are no copies; a few pairs among them are. Few pairs are compared."""
    common = "this notice must stay in all copies of"
    rows = [(i, f"{common} a{i} b{i} c{i} d{i}") for i in range(5000)]
    rows += [(10_000 + i, f"{common} a{i} b{i} c{i} d{i} e") for i in range(0, 5000, 500)]
    compared = []
    real = ngram_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    sets = {k: _set(t, 4) for k, t in rows}
    want = {k: k % 10_000 if k >= 10_000 and 100 * len(sets[k] & sets[k % 10_000]) >= 85 * len(sets[k] | sets[k % 10_000]) else k for k in sets}
    assert got == want and sum(compared) < 4 * len(rows)


@pytest.mark.parametrize("crowd", [2, 256])
def test_ngram_join_of_edits_of_one_text(spark, crowd, monkeypatch):
    """400 edits of one text, many of them too far from it but some near to each other, with small crowds and ordinary ones."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "SALT", 16)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(rows[rng.randrange(len(rows))][1].split()) if i % 3 == 0 else list(base)
        for k in rng.sample(range(80), rng.choice([1, 2, 3, 6, 10])):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    root = _components({k: _set(t, 4) for k, t in rows})
    least = defaultdict(lambda: 10**9)
    for k, r in root.items():
        least[r] = min(least[r], k)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: least[r] for k, r in root.items()} and len(set(got.values())) > 50


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(9,2)", "date"])
def test_ids_of_any_type(spark, corpus, kind):
    """All operators take ids of any type that Spark can order."""
    as_id = {"date": "date_add(date'2020-01-01', cast(doc_id as int))"}.get(kind, f"cast(doc_id as {kind})")
    frame = spark.createDataFrame(corpus[:40], DOCS).selectExpr(f"{as_id} as doc_id", "text", "lang", "source").repartition(2)
    labels = frame.selectExpr("doc_id", "cast(length(text) % 2 as int) as quality", "cast(length(text) % 3 = 0 as int) as toxic").distinct()
    bench = frame.select(F.col("doc_id").alias("item_id"), "text").limit(5)
    every = [
        mixing.mix(frame), url_filter.url_filter(frame, id_col="doc_id", url_col="text"), langid.identify(frame, frame), decontamination.contaminated(frame, bench), quality.quality_scores(frame, labels),
        sharding.shard(frame), matroska.digests(matroska.as_media(frame)), matroska.packet_table(matroska.as_media(frame)), toxicity.toxicity_scores(frame, labels), lm.lm_scores(frame), ngram_join.ngram_join(frame),
    ]
    for out in every:
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
        assert ids <= {r.doc_id for r in frame.select("doc_id").collect()} and len(ids) > 3


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7), (-5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize("block_shingles", [2_000_000, 30])
def test_decontamination(spark, docs, corpus, empty, block_shingles):
    rng = random.Random(1)
    long = next(r[1] for r in corpus if r[0] == 3005).split()
    items = [(1, " ".join(long[500:540])), (2, " ".join(long[900:920] + ["zz"] * 3)), (3, "one two"), (4, None), (5, ""), (6, " ".join(rng.choice(long) for _ in range(30))), (1, " ".join(long[500:540]))]
    items += [(10 + k, " ".join(long[100 : 100 + 5 + k] + ["q"] * (k % 3))) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in corpus:
        d = _set(r[1], 5)
        for i, t in items:
            s = _set(t, 5)
            if s and 5 * len(s & d) >= 4 * len(s):
                want[(r[0], i, len(s), len(s & d))] += 1
    got = decontamination.contaminated(docs, bench, block_shingles=block_shingles)
    assert Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()) == want
    clash = docs.withColumn("N_ITEMS", F.lit("x"))
    marked = decontamination.with_item_counts(clash, bench, block_shingles=block_shingles)
    assert marked.columns[:-1] == docs.columns
    assert decontamination.with_item_counts(empty, bench).count() == 0
    assert decontamination.with_item_counts(empty, bench, block_shingles=block_shingles).count() == 0
    assert marked.agg(F.sum("n_items")).collect()[0][0] == sum(want.values())
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("block_shingles", [40, 12])
def test_decontamination_writes_texts_once_whatever_the_blocks(spark, docs, monkeypatch, block_shingles):
    rng = random.Random(5)
    bench = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(14))) for i in range(30)], "item_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(bench.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" after")).alias("text")))
    frame = frame.withColumn("row", F.lit(7)).withColumn("row_", F.lit("x"))
    written, whole = [], decontamination.materialise
    monkeypatch.setattr(decontamination, "materialise", lambda df, *a: written.append(df.columns) or whole(df, *a))
    got = decontamination.with_item_counts(frame, bench, block_shingles=block_shingles)
    assert sum("text" in c for c in written) == 1 and len(written) > 6
    want = decontamination.with_item_counts(frame, bench)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert want.where("n_items > 0").count() >= 30


def test_url_filter_matches_sql(spark, tmp_path):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/1", "http://www.example.com/en/", "x://a.net/fr/9?q#f", "http://com", "http://com/", "http://xcom/en/1", "http://\u00c9x.net/es/1", "a://b://c/d"]
    urls += [f"http://h{rng.randrange(4)}.{rng.choice(['example.com', 'other.net', 'site.org'])}/{rng.choice(['en', 'fr', 'es', 'x'])}/{rng.choice(['a', 'b', str(rng.randrange(99)), 'slug-%d' % rng.randrange(999), 'w%s' % rng.random()])}" for _ in range(400)]
    frame = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string")
    frame.coalesce(1).write.parquet(str(tmp_path / "pages"))
    got = url_filter.url_filter(frame)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    cols = got.columns
    want = Counter(con.execute(f"select {', '.join(cols)} from ({SQL['op2_url_filter']})").fetchall())
    assert Counter(map(tuple, got.collect())) == want
    rules = {r.page_id: r.rule for r in got.collect()}
    assert rules[4] == "example.com/en/" and rules[5] == "www.example.com/en/" and rules[6] == "net/fr/" and rules[7] is None and rules[8] == "com/" and rules[9] is None
    assert url_filter.url_filter(frame.limit(0)).count() == 0


def _verdicts(spark, urls, **how):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return {r.url: r for r in url_filter.url_filter(frame, **how).join(frame, "page_id").collect()}


def test_url_filter_blocks_by_purity(spark):
    got = _verdicts(spark, [f"http://a.net/es/{i}" for i in range(80)] + [f"http://a.net/q{i}" for i in range(20)])
    assert got["http://a.net/es/0"].verdict == "block" and got["http://a.net/q3"].template == "/*"


def test_url_tree_pools_the_children_of_a_wildcard(spark):
    """60 users with 20 pages each: no page is frequent below one user, but below the wildcard each is rare among many."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ghijklmnopqrstuvw") for _ in range(7))
    users, pages = [word() for _ in range(60)], [word() for _ in range(20)]
    urls = [f"http://a.org/{u}/{p}" for u in users for p in rng.sample(pages, 3)]
    got = _verdicts(spark, urls)
    assert {r.template for r in got.values()} == {"/*/*"}
    # the same pages below a kept segment are generalised there alone
    rules = (("block", "a.org", "/list/top"), ("allow", "a.org", "/list/"))
    got = _verdicts(spark, [f"http://a.org/list/{p}" for p in pages] + ["http://a.org/list/top"] * 20, rules=rules)
    assert got["http://a.org/list/top"].template == "/list/top" and got[f"http://a.org/list/{pages[0]}"].template == "/list/*"


def test_url_branches_merge_when_alike(spark):
    rules = (("block", "a.org", "/ads/"), ("allow", "a.org", "/en/"), ("allow", "a.org", "/fr/"))
    urls = [f"http://a.org/{b}/{i}" for b in ("en", "fr", "de") for i in range(40)] + [f"http://a.org/ads/{i}" for i in range(60)]
    urls += [f"http://a.org/shop/{x}/{i}" for x in ("cart", "item") for i in range(30)]
    got = _verdicts(spark, urls, rules=rules)
    # two languages with the same children and no bad label; ads differ by their labels, the shop by its children
    assert len({got[f"http://a.org/{b}/1"].template for b in ("en", "fr")}) == 1 and got["http://a.org/fr/1"].labelled == 80
    assert got["http://a.org/ads/1"].template == "/ads/*" and got["http://a.org/shop/cart/1"].template.startswith("/shop/")
    # a lone wildcard is no evidence that the unlabelled branch is like them
    assert got["http://a.org/de/1"].template == "/de/*" and got["http://a.org/de/1"].labelled == 0 and got["http://a.org/de/1"].verdict == "allow"
    # unlabelled templates back off to their host, unlabelled hosts to the overall rate
    bad = (("block", "b.org", "/x/"),)
    got = _verdicts(spark, [f"http://b.org/x/{i}" for i in range(90)] + ["http://b.org/y/z/1", "http://c.org/"], rules=bad)
    assert got["http://b.org/y/z/1"].verdict == "block" and got["http://c.org/"].purity == 1.0
    assert _verdicts(spark, ["http://c.org/"], rules=bad)["http://c.org/"].verdict == "allow"


@pytest.mark.parametrize(("pages", "template"), [(["news", "sport"], "/+"), (["*"], "/new/*")])
def test_an_unlabelled_branch_joins_a_labelled_one_on_evidence_alone(spark, pages, template):
    """A host with a blocked, an allowed and an unlabelled branch: the last one is like the allowed one where its pages say so."""
    rules = (("block", "a.org", "/ads/"), ("allow", "a.org", "/en/"))
    under = lambda b, names: [f"http://a.org/{b}/{i if x == '*' else x}" for i in range(30) for x in names]
    got = _verdicts(spark, under("en", pages) + under("new", pages) + under("ads", ["click", "view", "buy"]), rules=rules)
    new = got[under("new", pages)[0]]
    assert got["http://a.org/ads/click"].template.startswith("/ads/") and got["http://a.org/ads/click"].purity > 0.8
    assert new.template.startswith(template) and new.verdict == "allow" and got[under("en", pages)[0]].purity < 0.3
    assert new.labelled == (0 if pages == ["*"] else 60) and (new.purity < 0.3) == (pages != ["*"])


def test_siblings_that_are_alike_meet_past_one_that_differs(spark):
    """The order puts like subtrees side by side, whatever the rate of a third sibling between them."""
    rules = (("block", "a.org", "/a/"), ("block", "a.org", "/b/"), ("allow", "a.org", "/a/x1"), ("allow", "a.org", "/m/"))
    urls = [f"http://a.org/{b}/{x}" for b in ("a", "b") for i in range(30) for x in ("x1", "x2")] + [f"http://a.org/m/{x}" for i in range(20) for x in ("y1", "y2", "y3")]
    got = _verdicts(spark, urls + ["http://a.org/m/y1"], rules=(("allow", "a.org", "/"),))
    assert got["http://a.org/a/x1"].template == got["http://a.org/b/x1"].template.replace("/b/", "/a/") and got["http://a.org/m/y1"].template.startswith("/m/")
    assert got["http://a.org/a/x1"].template.startswith("/+") and _verdicts(spark, urls, rules=rules)["http://a.org/m/y1"].template.startswith("/m/")


def test_a_branch_without_labels_follows_its_host_as_far_as_that_is_labelled(spark):
    rules = (("block", "a.org", "/bad/"), ("block", "b.org", "/bad/"), ("allow", "c.org", "/"))
    urls = [f"http://{h}.org/bad/{i}" for h in "ab" for i in range(40)] + [f"http://a.org/x/p{i % 2}" for i in range(2)] + [f"http://b.org/x/p{i % 2}" for i in range(400)] + [f"http://c.org/{i}" for i in range(40)]
    got = _verdicts(spark, urls, rules=rules)
    assert got["http://a.org/x/p1"].verdict == "block" and got["http://b.org/x/p1"].verdict == "allow"
    assert got["http://b.org/bad/1"].verdict == "block" and got["http://b.org/x/p1"].labelled == 0


def test_url_filter_takes_very_long_paths(spark):
    long = "http://a.org/" + "/".join(f"part{i}x" for i in range(50_000))
    got = _verdicts(spark, [long, "http://a.org/a/b"])
    assert got[long].template.count("/") == 50_000 and len(got) == 2


def test_language_id(spark, docs, empty):
    text = {"en": "the cat and the dog are here with that man", "de": "der hund und die katze sind nicht hier und das ist gut", "fr": "le chat et le chien ne sont pas dans la maison avec nous"}
    rng = random.Random(4)
    rows = [(i, _prose(rng, 30, text[k].split()), k) for i, k in enumerate(rng.choice(sorted(text)) for _ in range(120))]
    rows += [(900, None, "en"), (901, "12 !? 34", "de"), (902, "", None), (903, "\u00dcBER die katze und der hund", None), (904, "der hund " * 20000, "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(frame, frame.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "de"]
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(empty, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_profiles_match_brute_force(spark):
    rows = [("en", "The cat, the mat"), ("en", "a 1b c"), ("xx", "\u00c9\u00c9 zz"), (None, "skip"), ("xx", None), ("xx", "zz  zz ")]
    got = defaultdict(dict)
    for r in langid.profiles(spark.createDataFrame(rows, "lang string, text string"), size=1000).collect():
        got[r.lang][r.gram % (1 << 64)] = r.rank
    for lang in ("en", "xx"):
        count = Counter()
        for k, t in rows:
            if k == lang and t:
                s = " " + re.sub(r"[\W\d_]+", " ", t.lower())
                s = re.sub(" +", " ", s + " ")
                for n in (1, 2, 3):
                    for i in range(len(s) - n + 1):
                        g = s[i : i + n]
                        if (n == 1 and g != " ") or (n == 2 and g.strip()) or (n == 3 and g[1] != " " and g.strip()):
                            count[g] += 1

        def code(g):
            x = 0
            for ch in g:
                x = (x << 21) | (0 if ch == " " else ord(ch))
            return x | (0, 0, 1 << 62, 1 << 63)[len(g)]

        ranked = sorted(count, key=lambda g: (-count[g], code(g)))
        assert got[lang] == {code(g): i for i, g in enumerate(ranked)}


def test_language_distance_by_brute_force():
    """Out-of-place distance, ties and score on random profiles."""
    rng = random.Random(3)
    grams = list(range(1, 60))
    for size in (5, 20):
        lists = {k: rng.sample(grams, size) for k in ("aa", "bb", "cc")}
        lists["dd"] = list(lists["aa"])  # a tie: the first name wins
        model = langid.Model([type("R", (), {"lang": k, "gram": g, "rank": i}) for k, v in lists.items() for i, g in enumerate(v)], size)
        for _ in range(30):
            text = [rng.choice(grams) for _ in range(rng.randint(1, 200))]
            count = Counter(text)
            top = sorted(count, key=lambda g: (-count[g], g))[:size]
            far = {k: sum(abs(v.index(g) - i) if g in v else size for i, g in enumerate(top)) for k, v in lists.items()}
            order = sorted(far, key=lambda k: (far[k], k))
            lang, score = model.predict(np.array(text, np.uint64))
            assert lang == order[0] and math.isclose(score, (far[order[1]] - far[order[0]]) / far[order[1]] if far[order[1]] else 0.0)


def test_document_statistics_by_brute_force():
    texts = ["", "One two, TWO two! 3 a|b", "x", "A b A b a B\nend. \u00e9t\u00e9 #&", "word " * 5000 + "LAST;;"]
    got = np.concatenate([quality.statistics(c) for c in tokens.chunks(pa.array(texts), 64)])
    for t, row in zip(texts, got, strict=True):
        raw, w = t.encode(), _words(t)
        n, pairs = len(w), Counter(zip(w, w[1:], strict=False))
        chars = lambda s: sum(raw.count(x.encode()) for x in s)
        upper = sum(65 <= b <= 90 for b in raw)
        alpha = upper + sum(97 <= b <= 122 for b in raw)
        want = [
            math.log1p(n), math.log1p(sum(map(len, w)) / max(n, 1)), math.log1p(max(map(len, w), default=0)), math.sqrt(upper / max(alpha, 1)), math.sqrt(chars("#$%&*@^~<>=+\\/_{}[]") / max(len(raw), 1)),
            math.sqrt(chars("|") / max(len(raw), 1)), math.sqrt(chars("0123456789") / max(len(raw), 1)), math.sqrt(chars(".,;:") / max(n, 1)), math.sqrt(chars("!?") / max(len(raw), 1)), math.sqrt(chars("\n") / max(n, 1)),
            math.sqrt(sum(len(x) <= 3 for x in w) / max(n, 1)), math.log1p(len(set(w))) / math.log1p(max(n, 1)), math.sqrt(sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(n, 1)), math.sqrt(sum(v - 1 for v in pairs.values()) / max(n, 1)),
        ]
        assert np.allclose(row, want)


def test_quality(spark, empty):
    rng = random.Random(6)
    words = ["stone", "river", "the", "of", "a", "walking", "people"]

    def make(good):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        return " ".join(w) + "." if good else " ".join(x.upper() + rng.choice(["!!", "$$$", "***"]) for x in w)

    rows = [(i, make(i % 3 > 0), int(i % 3 > 0)) for i in range(300)]
    frame = spark.createDataFrame([(i, t, "n") for i, t, _ in rows] + [(900, None, "n"), (901, "", "n"), (0, rows[0][1], "n")], "doc_id long, text string, Score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(frame, labels).collect()
    assert len(got) == 303
    by = {r.doc_id: r for r in got}
    held = [r for r in by.values() if r.held_out and r.doc_id < 900]
    assert held and all(r.predicted == rows[r.doc_id][2] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and by[900].score == by[901].score
    kept = quality.keep_quality(frame, labels)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(frame, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(frame, labels.limit(0)).collect()} == {0.5}


def test_quadratic_discriminant_formula():
    rng = np.random.default_rng(0)
    d = len(quality.STATS)
    x = [rng.normal(size=(400, d)), rng.normal(size=(600, d)) @ rng.normal(size=(d, d)) * 0.3 + 1]
    m = np.stack([np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()]) for z in x])
    model = quality.Discriminant(m, pooled=0.0, ridge=0.0)
    z = np.concatenate([x[0][:5], x[1][:5]])
    log = []
    for k in (0, 1):
        mean, cov = x[k].mean(axis=0), np.cov(x[k].T, bias=True)
        gap = z - mean
        log.append(math.log(len(x[k]) / 1000) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(z), 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), atol=1e-6)


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, docs, empty, hot):
    if hot:  # a third of all rows are copies of one text
        frame = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot ', 50) else repeat(cast(id as string), cast(id % 40 as int)) end as text", "1 as slot")
    else:
        frame = docs
    got = sharding.shard(frame).collect()
    rows = frame.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in rows)
    total, most = defaultdict(int), max(r["size"] for r in got)
    for r in got:
        total[r.shard] += r["size"]
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(1 for r in got if r.shard == s)))
    assert set(total) <= set(range(24)) and {r.law for r in got} == {"bytes"}
    if hot:
        assert max(total.values()) - min(total.get(s, 0) for s in range(24)) <= 2 * most + 0.01 * sum(total.values()) / 24
    else:
        assert sharding.shard(docs).columns == [c for c in docs.columns if c.lower() not in sharding.OUT] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert sharding.shard(empty).count() == 0


def test_sharding_splits_a_hot_key(spark):
    """3,000 rows without an id, all of one text: near equal bytes all the same."""
    frame = spark.range(3000).selectExpr("cast(null as string) as doc_id", "'the same text' as text")
    got = sharding.shard(frame).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top")).collect()
    assert len(got) == 24 and all(abs(r.n - 125) <= 1 and r.slots == r.n == r.top + 1 for r in got)


def test_sharding_with_many_buckets(spark, monkeypatch):
    """Buckets that follow the data: more than the grid's first cells would hold, with splitters inside cells."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 100)
    frame = spark.range(20000).selectExpr("cast(id as int) as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    got = sharding.shard(frame, shards=8).select("doc_id", "shard", "slot", "size").collect()
    total = defaultdict(int)
    for r in got:
        total[r.shard] += r["size"]
    assert sorted(r.doc_id for r in got) == list(range(20000)) and max(total.values()) - min(total.values()) <= 200
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(1 for r in got if r.shard == k)))


def _tempered(size, a):
    x = [(t / sum(size)) ** a if t else 0.0 for t in size]
    return [v / sum(x) for v in x]


def _entropy(w):
    return -sum(v * math.log(v) for v in w if v)


def _most_read(size, w):
    r = [v / t for v, t in zip(w, size, strict=True) if t]
    return max(r) / min(r)


@pytest.mark.parametrize("flatten, limit", [(0.5, None), (0.5, 1.2), (0.0, None), (1.0, 3.0)])
def test_mixing_target_by_scan(flatten, limit):
    """The exponent against a fine scan of [0, 1] for the first value that is flat enough and within the limit."""
    size = [7000, 2000, 1000, 350, 0]
    goal = _entropy(_tempered(size, 1.0)) + flatten * (math.log(4) - _entropy(_tempered(size, 1.0)))
    fits = [k / 20000 for k in range(20001) if _entropy(_tempered(size, k / 20000)) <= goal + 1e-12 and (limit is None or _most_read(size, _tempered(size, k / 20000)) <= limit + 1e-12)]
    want = fits[0] if fits else 1.0
    assert abs(mixing.exponent(size, flatten, None, limit) - want) <= 1 / 20000 + 1e-9
    assert mixing.exponent([5, 5, 5]) in (0.0, 1.0)


def test_mixing(spark, docs, corpus, empty):
    got = mixing.mix(docs, repetition=3.0).collect()
    tokens_of, rows = defaultdict(int), defaultdict(Counter)
    for r in corpus:
        tokens_of[r[3]] += len(_words(r[1]))
        rows[r[3]][r[0], r[1]] += 1
    names = sorted(tokens_of, key=lambda s: (s is not None, str(s)))
    size = [tokens_of[s] for s in names]
    own = _entropy(_tempered(size, 1.0))
    goal = own + 0.5 * (math.log(len(size)) - own)
    a = got[0].exponent
    w = dict(zip(names, _tempered(size, a), strict=True))
    assert 0 < a < 1 and math.isclose(_entropy(w.values()), goal, rel_tol=1e-9) or math.isclose(_most_read(size, w.values()), 3.0, rel_tol=1e-9)
    assert {(r.exponent, round(r.entropy, 9), round(r.repetition, 9)) for r in got} == {(a, round(_entropy(w.values()), 9), round(_most_read(size, list(w.values())), 9))}
    least = min(w[s] / tokens_of[s] for s in names)
    e = {s: w[s] / tokens_of[s] / least for s in names}
    longest = max(len(_words(r[1])) for r in corpus)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.weight, w[s]) for r in mine)
        whole = math.floor(e[s] + 1e-9)
        for k in range(whole):
            assert Counter((r.doc_id, r.text) for r in mine if r.epoch == k) == rows[s]
        read = sum(r.n_tokens for r in mine)
        assert tokens_of[s] * e[s] - 1 <= read <= tokens_of[s] * e[s] + longest
        for k in {r.epoch for r in mine}:
            assert sorted(r.position for r in mine if r.epoch == k) == list(range(sum(1 for r in mine if r.epoch == k)))
    assert mixing.mix(empty).count() == 0
    for h in (0.85, 0.9, 1.05):
        x = _tempered([70, 20, 10], mixing.exponent([70, 20, 10], entropy=h))
        assert math.isclose(_entropy(x), h, rel_tol=1e-6)


def test_mixing_deals_alike_rows_into_many_blocks(spark):
    """A third of the rows are alike in source, id and text, a third share a null id."""
    frame = spark.range(9000).selectExpr("case when id % 3 = 2 then id end as doc_id", "case when id % 3 = 0 then 'same text here' else concat('w', id) end as text", "'s' as source")
    got = mixing.mix(frame).groupBy("block").count().collect()
    assert sum(r["count"] for r in got) == 9000 and len(got) == 35 and max(r["count"] for r in got) < 2 * 9000 / 35


def test_op1_target_binds_on_the_registered_table(spark):
    r = QUERIES["op1_source_mixing"](spark, SF).select("exponent", "entropy", "repetition").distinct().collect()
    assert len(r) == 1 and 0 < r[0].exponent < 1 and r[0].repetition > 1


def test_matroska(spark, docs, corpus, empty):
    media = matroska.as_media(docs)
    got = matroska.digests(media).collect()
    assert len(got) == len(corpus)
    want = Counter()
    for r in corpus:
        raw = (r[1] or "").encode()
        p = raw + bytes((-len(raw)) % 64 if raw else 64)
        want[(r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = Counter((r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest()) for r in media.collect())
    assert Counter((r.doc_id, r.media_bytes, r.media_sha256) for r in got) == stored
    table = matroska.packet_table(media.where("doc_id = 3005"))
    rows = table.orderBy("packet").collect()
    raw = media.where("doc_id = 3005").collect()[0].media
    assert b"".join(raw[r.start : r.start + r["size"]] for r in rows).rstrip(b"\0") == next(r[1] for r in corpus if r[0] == 3005).encode()
    assert [r.timestamp_ns for r in rows] == [k * matroska.FRAME * 10**9 // matroska.SAMPLE_RATE for k in range(len(rows))]
    assert matroska.packet_table(matroska.as_media(empty)).count() == 0 and matroska.digests(matroska.as_media(empty)).count() == 0


def test_matroska_lacing_groups_and_damage(spark):
    el, num = matroska._el, matroska._num
    frames = [b"a" * 3, b"b" * 700, b"c" * 2, b"d" * 300]
    blocks = b""
    for kind in (1, 3):
        blocks += el(matroska.BLOCK_GROUP, el(matroska.BLOCK, b"\x82\x00\x05" + bytes([kind << 1]) + matroska.lace(frames, kind)) + (num(matroska.REFERENCE, 1) if kind == 3 else b""))
    blocks += el(matroska.SIMPLE_BLOCK, b"\x82\xff\xff\x84" + matroska.lace([b"xy"] * 5, 2))
    unknown = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7  # a cluster of unknown size
    raw = el(matroska.EBML, b"") + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + unknown + num(matroska.TIMESTAMP, 10) + blocks + el(matroska.CLUSTER, num(matroska.TIMESTAMP, 20) + el(matroska.SIMPLE_BLOCK, b"\x82\x00\x01\x80zz"))
    m = matroska.parse(raw)
    assert m.error is None and m.clusters == 2
    assert [raw[p[2] : p[2] + p[3]] for p in m.packets] == frames * 2 + [b"xy"] * 5 + [b"zz"]
    assert [p[1] // 10**6 for p in m.packets] == [15] * 8 + [9] * 5 + [21]
    assert [p[4] for p in m.packets] == [True] * 4 + [False] * 4 + [True] * 6
    for cut in range(len(raw)):
        bad = matroska.parse(raw[:cut])
        assert len(bad.packets) <= len(m.packets)
    frame = spark.createDataFrame([(1, bytearray(raw[:-1])), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    got = matroska.packet_table(frame).collect()
    assert {r.doc_id for r in got} == {1, 3} and all(r.error for r in got)
    rows = {r.doc_id: r for r in matroska.digests(frame.withColumn("n_bytes", F.lit(0))).collect()}
    assert rows[2].payload_sha256 is None and rows[2].error is None and rows[1].error and rows[3].error
    assert rows[1].payload_bytes == sum(r["size"] for r in got if r.doc_id == 1 and r.packet is not None) and rows[3].payload_bytes == 0


def test_toxicity(spark, empty):
    rng = random.Random(8)
    words = ["stone", "river", "green", "walk", "people", "house", "table"]

    def make(bad, i):
        w = [rng.choice(words) for _ in range(12)]
        if bad:
            w.insert(3, rng.choice(["idiot", "scummy.", "SCUM"]))
        return " ".join(w)

    rows = [(i, make(i % 4 == 0, i), int(i % 4 == 0)) for i in range(600)]
    frame = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(900, None, 0), (901, "", 0), (902, "river " * 50000 + "scum", 0)], "doc_id long, text string, SCORE int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame, labels).collect()}
    assert len(got) == 603 and got[902].predicted == 1 and got[900].score == got[901].score < 0.5
    assert all(got[i].predicted == y for i, _, y in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(frame, labels.limit(0)).collect()} == {0.5}
    small = toxicity.toxicity_scores(frame, labels, fit_rows=100)
    assert small.count() == 603


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rng = random.Random(8)
    words = ["stone", "river", "green", "walk", "people", "house", "table"]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(8)]
        bad = i % 2
        if bad:
            w += ["muslims"] * (rng.random() < 0.9) + ["vermin"] * (rng.random() < 0.7)
        elif rng.random() < 0.05:
            w += ["muslims"]
        rows.append((bad, " ".join(w)))
    frame = spark.createDataFrame(rows, "label int, text string")
    probe = next(tokens.chunks(pa.array(["muslims walk the river", "christians walk the river"])))
    free, fair = toxicity.fit(frame, fair=0.0).score(probe), toxicity.fit(frame, fair=10.0).score(probe)
    assert abs(fair[0] - fair[1]) < 0.3 * abs(free[0] - free[1]) and fair[0] < free[0]
    assert toxicity.swaps("The Women met a man.") == ["The men met a woman.", "The  met a ."]
    assert toxicity.swaps("Die Frauen und Männer") == ["Die männer und frauen", "Die  und "]


def test_counterfactual_objective_by_brute_force():
    """Loss as written down, gradient by differences, and the fit at a stationary point."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(9) < 0.4) for _ in range(40)]
    y = (rng.random(40) < 0.4).astype(float)
    pairs = [(rng.choice(9, 2, replace=False), rng.choice(9, 1)) for _ in range(12)]
    swapped = toxicity.moments(Counter((tuple(a), tuple(b)) for a, b in pairs))
    assert swapped.n == len(pairs)
    loss = toxicity.objective(rows, y, swapped, 9, 0.01, 0.7)

    def plain(x):
        w, value = x[:-1], 0.0
        for r, t in zip(rows, y, strict=True):
            p = 1 / (1 + math.exp(-(sum(w[k] for k in r) + x[-1])))
            value -= (math.log(p) if t else math.log(1 - p)) / len(rows)
        return value + 0.01 * sum(v * v for v in w) + 0.7 * sum((sum(w[k] for k in a) - sum(w[k] for k in b)) ** 2 for a, b in pairs) / len(pairs)

    x = rng.normal(size=10)
    value, g = loss(x)
    assert math.isclose(value, plain(x), rel_tol=1e-12)
    for k in range(10):
        up, down = x.copy(), x.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert math.isclose(g[k], (plain(up) - plain(down)) / 2e-6, rel_tol=1e-5, abs_tol=1e-7)
    fitted = toxicity.Linear(rows, y, swapped, 9, 0.01, 0.7)
    assert np.abs(loss(np.append(fitted.weight, fitted.bias))[1]).max() < 1e-3


def test_swaps_are_counted_as_by_whole_sentences():
    """Features lost and won by each swap of each sentence, from the features of the two sentences."""
    rng = random.Random(6)
    words = ["women", "Men", "womanly", "muslim", "“jews”", "atheist-men", "frau", "frauen", "stone", "hinduism", "mène", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", ". ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "women"]
    sets = lambda t: [x for c in tokens.chunks(pa.array(t, pa.string())) for x in toxicity.feature_sets(c)]
    vocabulary = toxicity.Vocabulary(np.concatenate(sets(words)[:-1]))
    want = Counter()
    for text in texts:
        for sentence in re.findall(r"[^.!?\n]+", text):
            have, *others = (set(vocabulary.find(x).tolist()) for x in sets([sentence, *toxicity.swaps(sentence)]))
            want.update((tuple(sorted(have - x)), tuple(sorted(x - have))) for x in others if x != have)
    swapper = toxicity.Swapper(vocabulary, toxicity.IDENTITY)
    assert want and sum((swapper.count(t) for t in texts), Counter()) == want


def test_op8_has_swaps_on_the_registered_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.toxicity_model(docs, labels).swaps > 100


def test_found_groups_are_neutral_words_of_one_place(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 2
        rows.append((bad, f"near the {rng.choice(['north', 'south', 'east'])} a {rng.choice(['tree', 'house'])} {'scum' if bad else 'fine'} the {'vermin' if bad and i % 3 else 'guest'}"))
    groups = toxicity.found_groups(spark.createDataFrame(rows, "label int, text string"), {0: 200, 1: 200})
    words = {w for g in groups for w in g}
    assert not words & {"scum", "vermin", "fine", "guest"} and any(set(g) <= {"north", "south", "east"} for g in groups)


def test_lm(spark, docs, corpus, empty):
    got = lm.lm_scores(docs, heads=8, top=40).collect()
    train = [r for r in corpus if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = Counter(w for r in train for w in [*_words(r[1]), None])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for r in corpus:
        w = [*_words(r[1]), None]
        want[r[0], len(w), sum(count[x] > 0 for x in w)].append(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id, r.n_tokens, r.n_known].append(r.base_score)
        assert r.train_tokens == n and r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert have.keys() == want.keys()
    assert all(np.allclose(sorted(have[k]), sorted(want[k])) for k in want)
    assert lm.lm_scores(empty).count() == 0


def test_lm_is_a_distribution_and_em_climbs():
    rng = np.random.default_rng(1)
    kept, held = rng.integers(0, 4, (12, 12)), rng.integers(0, 4, (12, 12))
    kept[5] = 0
    p = 10 ** lm.transitions(kept, held)
    assert np.allclose(p.sum(axis=1), 1)

    def likelihood(lam):
        c = kept.sum(axis=1)
        f = lam[lm.bucket_of(c)]
        q = f[:, :1] / 12 + f[:, 1:2] * kept.sum(axis=0) / kept.sum() + f[:, 2:] * kept / np.maximum(c, 1)[:, None]
        return (held * np.log(np.maximum(q, 1e-300))).sum()

    few, many = likelihood(lm.weights(kept, held, 1)), likelihood(lm.weights(kept, held, 40))
    assert many >= few
    words = np.arange(1, 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lex = lm.Lexicon(words, np.arange(29, 0, -1), 500, 60, 8)
    inside = 10**lex.inside
    for k in set(lex.cls.tolist()):
        assert math.isclose(inside[lex.cls == k].sum(), 1)
    assert lex.find(np.append(words[::-1], [np.uint64(5)])).tolist()[-1] == -1 and (lex.hash[lex.find(words)] == words).all()


class PlainModel:
    """The interpolated model of the module's docstring, word by word, from dictionaries."""

    def __init__(self, train, heads):
        texts = [[*_words(t), None] for _, t in train]
        name = lambda w: int(tokens.END) if w is None else int(tokens.words(next(tokens.chunks(pa.array([w.decode()])))).hash[0])
        self.heads, self.count = heads, Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        ranked = sorted(self.count, key=lambda w: (-self.count[w], name(w)))
        self.cls = {w: k if k < heads else heads + int(math.log2(k / heads + 1e-12)) for k, w in enumerate(ranked)}
        self.rare, self.c = heads + 19, heads + 20
        self.mass = Counter()
        for w, k in self.cls.items():
            self.mass[k] += self.count[w] + 0.5
        self.mass[self.rare] += 0.5
        pairs = {0: Counter(), 1: Counter()}
        self.seen = Counter()
        for (i, _), t in zip(train, texts, strict=True):
            out = int(zlib.crc32(str(i).encode()) // 5 % 10 == 0)
            for v, w in zip([None, *t], t, strict=False):
                pairs[out][self.cls[v], self.cls[w]] += 1
                self.seen[v, w] += 1
        self.lam = self._weights(pairs[0], pairs[1])
        self.pairs = pairs[0] + pairs[1]
        self.from_, self.one = Counter(), Counter()
        for (x, y), m in self.pairs.items():
            self.from_[x] += m
            self.one[y] += m
        self.a = self._pair_weights()

    def _weights(self, kept, held):
        start, one = Counter(), Counter()
        for (x, y), m in kept.items():
            start[x] += m
            one[y] += m
        lam = defaultdict(lambda: [0.02, 0.49, 0.49], {0: [0.02, 0.98, 0.0]})
        for _ in range(60):
            got = defaultdict(lambda: [0.02, 0.49, 0.49])
            for (x, y), m in held.items():
                b = int(math.log2(start[x] + 1.0))
                part = [q * f for q, f in zip(lam[b], (1 / self.c, one[y] / max(1, sum(kept.values())), kept[x, y] / max(1, start[x])), strict=True)]
                got[b] = [g + m * q / sum(part) for g, q in zip(got[b], part, strict=True)]
            lam = defaultdict(lambda: [0.02, 0.49, 0.49], {b: [q / sum(g) for q in g] for b, g in got.items()})
            if 0 not in lam:
                lam[0] = [0.02, 0.49, 0.49]
        return lam

    def classes(self, x, y):
        l0, l1, l2 = self.lam[int(math.log2(self.from_[x] + 1.0))]
        if not self.from_[x]:
            l1, l2 = l1 + l2, 0.0
        return l0 / self.c + l1 * self.one[y] / self.n + l2 * self.pairs[x, y] / max(1, self.from_[x])

    def parts(self, v, w):
        """count, denominator, lower estimate, and whether v is a head."""
        x, y = self.cls.get(v, self.rare), self.cls.get(w, self.rare)
        inside = (self.count[w] + 0.5) / self.mass[y]
        if x < self.heads:
            d = sum(m for (a, b), m in self.seen.items() if a == v and self.cls[b] == y)
            return self.seen[v, w], d, inside, True
        return self.seen[v, w], self.count[v], inside * self.classes(x, y), False

    def _pair_weights(self):
        cells = Counter()
        for (v, w), c in self.seen.items():
            if self.cls[v] < self.heads and self.cls[w] < self.heads:
                continue
            _, d, low, head = self.parts(v, w)
            if d > 1:
                left = (c - 1) / (d - 1) / low * (self.count[w] + 0.5) / max(self.count[w] - 0.5, 0.5)
                cell = min(255, max(1, int(128 + 4 * math.log2(left)))) if left > 0 else 0
                cells[(0 if head else 64) + int(math.log2(d)), cell] += c
        a = defaultdict(lambda: 0.5)
        for _ in range(60):
            up, total = Counter(), Counter()
            for (k, j), m in cells.items():
                r = 2.0 ** ((j + 0.5 - 128) / 4) if j else 0.0
                up[k] += m * a[k] * r / (a[k] * r + 1 - a[k])
                total[k] += m
            a = defaultdict(lambda: 0.5, {k: (up[k] + 0.5) / (total[k] + 1) for k in total})
        a[0] = a[64] = 0.0
        return a

    def log10(self, text):
        out, t = 0.0, [*_words(text), None]
        for v, w in zip([None, *t], t, strict=False):
            x, y = self.cls.get(v, self.rare), self.cls.get(w, self.rare)
            if x < self.heads and y < self.heads:
                out += math.log10(self.classes(x, y) * (self.count[w] + 0.5) / self.mass[y])
                continue
            c, d, low, head = self.parts(v, w)
            a = self.a[(0 if head else 64) + int(math.log2(d + 1.0))]
            out += math.log10((a * c / max(d, 1) + (1 - a) * low) * (self.classes(x, y) if head else 1.0))
        return out


def test_lm_against_a_plain_model(spark):
    """All scores against word-by-word dictionaries; every word of training is in the lexicon."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(400 + i, f"w1 new{i} W2 new{i}") for i in range(6)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    plain = PlainModel(train, heads=6)
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heads=6, top=1000).collect()}
    want = {i: plain.log10(t) for i, t in rows}
    assert max(abs(got[i] - want[i]) / abs(want[i]) for i in want) < 1e-6


@pytest.mark.parametrize("top", [4, 12, 1000])
def test_lm_word_pairs_beyond_the_heads(spark, top):
    """Two-word texts over the whole vocabulary: the model is a distribution, and pairs seen in training count whatever the words' ranks."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(20)]
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(train.pop(), " ".join(x for _ in range(rng.randint(1, 6)) for x in rng.choice([("w17", "w18"), (rng.choice(words[: rng.randint(1, 20)]),)]))) for _ in range(120)]
    seen = sorted({x for _, t in rows for x in t.split()})
    every = [*seen, "unseen"]
    ids = {t: held.pop() for t in [*every, *[f"{x} {y}" for x in every for y in every], ""]}
    frame = spark.createDataFrame(rows + [(i, t) for t, i in ids.items()], "doc_id long, text string").repartition(3)
    score = {r.doc_id: r.score for r in lm.lm_scores(frame, heads=3, top=top).collect()}
    p = {t: 10 ** score[i] for t, i in ids.items()}
    # similar to the matrix of P(w | v): the largest eigenvalue of a distribution's is 1, here less what l0 gives to classes without words
    q = np.array([[p[""], *[p[x] for x in every]], *[[1.0, *[p[f"{x} {y}"] / p[x] for y in every]] for x in every]])
    assert 0.998 < max(abs(np.linalg.eigvals(q))) < 1.00001
    assert p["w17 w18"] / (p["w17"] * p["w18"]) > 5 * p["w18 w17"] / (p["w17"] * p["w18"])


def test_lm_packs_stay_small_with_many_buckets():
    """Bytes that travel for each word with few and many buckets: a text's number costs a byte or two for each pair, not sixteen."""
    from types import SimpleNamespace as Box

    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for _ in range(500)])
    (chunk,) = tokens.chunks(texts, 1 << 30)
    h, n = np.unique(tokens.words(chunk).hash, return_counts=True)
    h, n = np.append(h[:1500], lm.END), np.append(n[:1500], 500)
    order = np.argsort(h)
    lex = lm.Lexicon(h[order], n[order], 30_500, 3001, 16)
    table = np.full((lex.classes, lex.classes), -1.0)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500) + (3 << 33)), pa.array(np.arange(500)), pa.array(np.arange(500) % 5 == 1), texts], names=["rid", "id", "held_out", "text"])
    for buckets, most in ((4, 16), (400, 22)):
        out = list(lm._score(Box(value=lex), Box(value=table), buckets, pa.int64())([batch]))
        size = sum(len(v.as_py()) for b in out for c in ("words", "refs", "texts") for v in b.column(c) if v.is_valid)
        assert size < most * 30_000, (buckets, size / 30_000)


def test_lm_numbers_in_planes_come_back():
    for a in ([0], [255, 0], [256, 1, 70_000], [0, 1 << 40, 3], [(1 << 62) + 5, 9]):
        a = np.array(a)
        assert (lm._wide(lm._narrow(a), len(a)) == a).all() and (lm._wide(lm._planes(a, 8), len(a)) == a).all()
    rid, held = np.array([7, 7, 9, (5 << 33) + 1, (5 << 33) + 300]), np.array([1, 1, 0, 1, 0])
    back, train = lm._of_texts(lm._texts(rid, held), 5)
    assert (back == rid).all() and (train == (held == 0)).all()
