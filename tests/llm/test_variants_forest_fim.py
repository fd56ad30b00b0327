"""Spelling variants, the MinHash forest and fill-in-the-middle against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import fim, forest, ngram_join, spelling
from assay.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_minhash_forest", "op13_fill_in_middle"])
def test_queries_match_sql(spark, name):
    assert difference(spark, connect(SF), QUERIES[name], SQL[name], SF) is None


# ---- fill-in-the-middle ---------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "\n", "a\n\nb", "a\n\nb\n", "é\nü" * 40, "\U0001f600x" * 30 + "\r\n", "x" * 300, "\n" * 130])
@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("every", [1, 3, 64])
@pytest.mark.parametrize("block", [1, 2, 7, 1 << 16])
def test_checkpoints_find_every_border(text, unit, every, block):
    index = fim.Checkpoints(text.encode(), unit, every, block)
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    assert index.n == len(units) and len(index.units) == 1 + len(units) // every
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.cut(k) == (len(before.encode()), len(before))


def _fim(text, key, unit="line", rate=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    x = hashlib.sha256(key.encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


FIM_TEXTS = [None, "", "one line", "a\nb\nc\nd\n", "ü\n\n\nß", "has <S> in it\n", "ends in <\nS>\n<", "P>\n<M\n>", "x" * 500_000 + "\n" + "y\n" * 1000, "\r\n \x0b\n", "a\nb\nc\nd\n"]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 60, 0), ("line", 100, 100), ("char", 0, 50)])
def test_fill_in_middle(spark, unit, rate, spm):
    rows = [(None if i == 3 else f"id-{i}", t, i, "mine") for i, t in enumerate(FIM_TEXTS)]
    docs = spark.createDataFrame(rows, "key string, body string, FORM int, row string").repartition(3)
    made = fim.fill_in_middle(docs, "key", "body", unit, rate, spm, seed=11, every=5)
    assert made.columns == ["key", "body", "row", *fim.OUT]
    got = made.withColumn("back", fim.restored("fim", "form")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.fim) == _fim(r.body, f"11:{r.key or ''}", unit, rate, spm)
        assert r.back == (r.body or "") and r.row == "mine"


def test_fill_in_middle_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(empty).collect() == [] and fim.digests(empty).columns[1] == "n"
    with pytest.raises(ValueError):
        fim.fill_in_middle(empty, unit="word")


# ---- spelling variants ----------------------------------------------------------------------------


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _edits(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])


@pytest.mark.parametrize("hits", [1, 1 << 20])
def test_near_pairs_by_brute_force(spark, hits, monkeypatch):
    monkeypatch.setattr(spelling, "HITS", hits)
    rng, letters = random.Random(3), "abcéÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 13))) for _ in range(150)}
    for w in list(words):
        words |= {_edits(rng, w, letters) for _ in range(4)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "é" * 40_000, "é" * 40_001, "é" * 39_999 + "a"}
    words = sorted(w for w in words if len(w) >= 7)
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = [(r.word, r.near, r.near_n) for r in spelling.near_pairs(table).collect()]
    n = {w: i + 2 for i, w in enumerate(words)}
    expected = {(a, b, n[b]) for a in words for b in words if a != b and abs(len(a) - len(b)) <= 1 and _one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 500


def test_batches_may_cut_a_block(spark):
    words = [("prefixa" + chr(97 + i) + "suffix", i + 2) for i in range(26)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = spelling.near_pairs(spark.createDataFrame(words, "word string, n long")).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == 26 * 25


def test_variants_by_brute_force(spark):
    rng, letters = random.Random(8), "abcdé"
    base = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(12)]
    texts = []
    for i in range(120):
        t = " ".join(rng.choices(base, weights=[2**k for k in range(12)], k=60))
        texts.append((i, t + " " + " ".join(_edits(rng, rng.choice(base), letters) for _ in range(20)) + " Ärger ÀÉ×÷ÿabcd x1y2 short", "a", i))
    texts += [(None, "abcdabcd, abcdabcd", "n", 1), (500, None, None, None), (501, "", "", 0), (502, "12 \n", "", 0), texts[3], (503, base[0] * 3000, "long", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, word string, n int").repartition(4)
    count = Counter()
    for i, t, *_ in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in count if _one_edit(v, w)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    expected = {w: (n, len(near[w]), form[w], count[form[w]] if form[w] else None, root(w)) for w, n in count.items()}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, noise=31).collect()}
    assert got == expected and sum(f is not None for f in form.values()) > 20
    assert spelling.variants(docs.where("false")).collect() == []


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w3")], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w37"}


# ---- LSH forest -----------------------------------------------------------------------------------


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset())
    return out


def _components(rows):
    sets = _sets([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            c = min(ids, default=None) if sets[i] else rows[i][0]
            out[(rows[i][0], len(sets[i]), c, rows[i][0] == c)] += 1
    return out


def _near_corpus(seed, groups, edits, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(edits):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, size // 18))):
                w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
        rows.append((k, " ".join(base).upper()))
        k += 1
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "One Two"), (None, rows[0][1]), (None, None), (None, "nobody else has this"), (3, rows[3][1]), (9005, " ".join(words * 40))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("crowd", "most", "batch"), [(128, 1 << 18, 10_000), (4, 1 << 18, 10_000), (4, 3, 7)])
def test_forest_by_brute_force(spark, crowd, most, batch, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(forest, "MOST", most)
    rows = _near_corpus(crowd, 8, 25, 90)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, CLASS int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = Counter(tuple(r) for r in forest.near_duplicates(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _components(rows)


def test_forest_of_nothing_and_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "a b c d e"), ("a", "A b c d e"), (None, "x")], "k string, t string")
    got = {r.k: (r.component_id, r.kept) for r in forest.near_duplicates(docs, "k", "t").collect()}
    assert got == {"b": ("a", False), "a": ("a", True), None: (None, True)}
    assert forest.near_duplicates(docs.where("false"), "k", "t").collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both, own = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
        a, b = (forest.signature(np.unique(np.r_[both, x]), step) for x, step in zip(own, (1024, 37), strict=True))
        errors.append((a == b).mean() - 400 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_depth_follows_the_crowd():
    value = np.zeros((300, forest.DEPTH), np.uint32)
    value[:100, 5] = np.arange(100)  # 100 rows part at the sixth value, 200 never do
    value[100:, 4] = 1
    shared = forest.common_prefix(np.zeros(300, np.int32), value)
    depth = forest.depths(shared, 60)
    assert set(depth[:100].tolist()) == {6} and set(depth[100:].tolist()) == {forest.DEPTH}
    assert set(forest.depths(shared, 300).tolist()) == {forest.LEAST_DEPTH}


def test_forest_recall_on_pairs_at_the_threshold(spark):
    """Pairs that barely link, without any third text that could join them."""
    rng = random.Random(2)
    rows = []
    for k in range(400):
        base = [f"t{k}w{i}" for i in range(102)]
        edited = list(base)
        edited[rng.choice([0, 101])] = "x"  # one shingle each way
        for i in (20, 50):
            edited[i] = "y"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(400)) == 400
