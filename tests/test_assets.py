"""Similarity join of names: the same pairs as by comparing all with all."""

import random

from assay.operators import assets


def _names(rng, n, more=()):
    """Names that folding leaves as they are, but for parts in ``more``."""
    parts = ["main", "valve", "service", "pump", "hydrant", "meter", "line", "gate", *more]
    out = []
    for _ in range(n):
        w = list("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("aeimnrstv")
        out.append("".join(w) if rng.random() > 0.06 else rng.choice(["", None]))
    return out


def _best(rows, base, least):
    """All with all, by the score itself."""
    fold = lambda v: v or ""
    known = {b[0] for b in base}
    out = {}
    for c, g, t in rows:
        if not (fold(g) or fold(t)):
            continue
        scores = [(-assets._score(fold(g), fold(t), fold(bg), fold(bt)), fold(bg), fold(bt), bg, bt) for bc, bg, bt in base if bc == c or c not in known]
        best = min((s for s in scores if -s[0] >= least), key=lambda s: s[:3], default=None)
        if best:
            out[c, g, t] = (fold(best[3]), fold(best[4]), round(-best[0], 3))
    return out


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(14)
    rows = list(dict.fromkeys(zip([rng.choice(["pipes", "nodes", "other", "lost"]) for _ in range(600)], _names(rng, 600), _names(rng, 600), strict=True)))
    base = list(dict.fromkeys(zip([rng.choice(["pipes", "nodes", "spare"]) for _ in range(400)], _names(rng, 400), _names(rng, 400), strict=True)))
    groups = ["main", "valve", "meterline"]  # some with equal groups, so that types decide
    rows += [("pipes", rng.choice(groups), t) for t in _names(rng, 100)] + [("lost", "main", t) for t in _names(rng, 60)]
    base += [("pipes", rng.choice(groups), t) for t in _names(rng, 100)]
    found = spark.createDataFrame([(*r, 1) for r in dict.fromkeys(rows)], "class_name string, asset_group string, asset_type string, features long")
    got = assets.fuzzy(found, spark.createDataFrame(base, "class_name string, asset_group string, asset_type string"))
    want = _best(list(dict.fromkeys(rows)), base, assets.FUZZY)
    have = {(r.class_name, r.asset_group, r.asset_type): (r.match_group or "", r.match_type or "", r.confidence) for r in got.collect()}
    assert len(want) > 100 and have == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fuzzy_of_empty_tables_and_repeated_rows(spark):
    kind = "class_name string, asset_group string, asset_type string"
    one = spark.createDataFrame([("pipes", "main", "steel pipe"), ("pipes", "main", "steel pipe"), ("pipes", None, None), (None, "main", "steel pipe")], kind)
    base = spark.createDataFrame([("pipes", "main", "steel pipes"), ("pipes", "main", "steel pipes")], kind)
    assert assets.fuzzy(one.limit(0), base).count() == 0 and assets.fuzzy(one, base.limit(0)).count() == 0
    got = assets.fuzzy(one.where("class_name is not null"), base).collect()
    assert [r.match_type for r in got] == ["steel pipes"] * 2


def test_letters_bound_the_similarity(spark):
    rng = random.Random(3)
    pairs = [(a or "", b or "") for a, b in zip(_names(rng, 300, ["älv", "𝛼x"]), _names(rng, 300, ["älv", "𝛼x"]), strict=True)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("common", assets.F.size(assets.F.array_intersect(assets.letters("a"), assets.letters("b"))))
    for r in df.collect():
        assert r.common == sum(min(r.a.count(c), r.b.count(c)) for c in set(r.a))
        if r.a or r.b:
            assert assets.SequenceMatcher(None, r.a, r.b).ratio() <= 2 * r.common / (len(r.a) + len(r.b)) + 1e-12
