import random
from collections import Counter

import corpus_pipeline
from assay.llm import decontamination, ngram_join


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["stone", "river", "green", "walk", "people", "house", "table", *[f"w{i}" for i in range(300)]]

    def make(good):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        return " ".join(w) + "." if good else " ".join(x.upper() + rng.choice(["!!", "$$$", "***"]) for x in w)

    good = {i: i % 4 != 0 for i in range(200)}
    text = {i: make(good[i]) for i in good}
    copies = {1000 + i: i for i in good if good[i] and i % 3 == 0}
    text |= {k: text[i] for k, i in copies.items()}
    item = " ".join(rng.choice(words) for _ in range(20))
    dirty = {i for i in good if good[i] and i % 10 == 1}
    text |= {i: text[i] + " " + item + " end" for i in dirty}
    copies = {k: i for k, i in copies.items() if i not in dirty}
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3] if i % 2 else "a", len(t)) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(g), 0) for i, g in good.items() if i % 2 == 0 or g], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert frame.columns == docs.columns
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
    keep = {i for i in text if good[i % 1000]}
    assert seen[0] == keep
    assert seen[1] == {i for i in keep if i not in copies}
    assert seen[2] == seen[1] - dirty - {k for k in keep if k - 1000 in dirty and item in text[k]}
    assert seen[3] == seen[2] == seen[4]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen[4] and len(corpus_pipeline.STAGES) == 5
    assert ngram_join.ngram_join(docs).count() == len(text) and decontamination.LEAST == 0.8


def test_near_copies_of_five_word_similarity_80(spark):
    rows = []
    for k, (n, more, cut) in enumerate([(49, 0, 24), (52, 0, 24), (200, 45, None), (8, 1, None), (48, 0, 24), (200, 53, None)]):
        w = [f"w{k}x{i}" for i in range(n)]
        v = w + [f"m{k}x{i}" for i in range(more)]
        if cut:
            v[cut] = "edited"
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(v))]

    def similarity(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    want = set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        want |= {i} if similarity(a, b) >= 0.8 else {i, j}
    assert want == {0, 10, 20, 30, 40, 41, 50, 51}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()} == want


def test_awkward_rows(spark, tmp_path):
    """Repeated and null ids, repeated rows, null, empty and very long texts, columns named like the stages' own: nothing is lost by chance."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d, long = prose(30), prose(30), prose(30), prose(30), prose(200_000)
    item = prose(12)
    rows = [(7, a), (7, b), (None, c), (None, c), (None, d), (8, None), (8, None), (9, ""), (10, long), (11, long + " end"), (12, d), (12, d), (13, prose(20) + " " + item), (14, " \t")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else "s", 1, "x", "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, N_Items string, Shard string")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, a), (7, b), (None, c), (8, None), (8, None), (9, ""), (10, long), (12, d), rows[12], rows[13]])
    spark.createDataFrame([(13, item), (None, item), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {(r.doc_id, r.text) for r in kept.collect()} - {rows[12]}
    assert {(r.doc_id, r.text) for r in out} == want
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(1 for r in out if r.shard == s)))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (k == 4 or none.columns == docs.columns)
