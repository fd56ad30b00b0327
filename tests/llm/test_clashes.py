"""Columns of the input that are named like an operator's own helpers come through unharmed."""

import pytest
from pyspark.sql import functions as F

from assay.llm import mixing, ngram_join, sharding

HELPERS = ["__s", "__b", "__h", "__key", "__low", "__th", "__id", "__salt", "__size", "__cell", "__rest", "__t", "kept_0"]


@pytest.mark.parametrize("step", [mixing.mix, sharding.shard, ngram_join.one_each])
@pytest.mark.parametrize("own", [False, True])
def test_helper_names(spark, step, own):
    rows = [(i, f"some words of text {i % 7} and more of them", "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{h}-"), F.col("doc_id").cast("string")).alias(h) for h in HELPERS])
    more = {}
    if own:  # the id itself has such a name
        docs, more = docs.withColumnRenamed("doc_id", "__n"), {"id_col": "__n"}
    key = more.get("id_col", "doc_id")
    out = step(docs, **more)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    got = out.collect()
    assert got and all(r[h] == f"{h}-{r[key]}" for r in got for h in HELPERS)
    if step is sharding.shard:
        assert sorted(r[key] for r in got) == list(range(40))
