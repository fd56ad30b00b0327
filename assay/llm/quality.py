"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a dozen statistics (length, word length, shares of capitals,
symbols, digits, punctuation, short words, repetition of words and word pairs,
...), transformed to be closer to normal (log, square root).  Both classes get
their own mean and a covariance shrunk towards the pooled covariance and a
multiple of the identity; the score is the logistic of the difference of the
two Mahalanobis log-densities plus the log prior odds.  Cholesky factors and
log determinants are computed once and travel to the tasks.

Statistics go to a scratch table in one pass over the texts, so texts are never
shuffled.  Training needs only counts, sums and cross products of each class,
summed in each task: all labelled rows are used, whatever their number.

Labels other than 0 and 1 (and null) are not learned from; with labels of one
class only, every score is that class's prior (1 or 0), with none 0.5.  A label
row and a document row with the same id make one example each time they meet.
Null texts are scored as empty ones; texts of any length are scored whole, in
chunks of bounded size.  Repeated rows are all returned; an empty table gives an
empty result; other columns are ignored.  Ids may have any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import tokens
from assay.llm.common import freeing, materialise, remainder, small_batches, text_udf, without

STATS = ("words", "word_length", "longest", "capitals", "symbols", "bars", "digits", "stops", "shouts", "lines", "short", "distinct", "same_as_before", "pairs_repeated")


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _ALPHA, _DIGIT = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)])), _class(b"0123456789")
_SYMBOL, _BAR, _STOP, _SHOUT, _LINE = _class(b"#$%&*@^~<>=+\\/_{}[]"), _class(b"|"), _class(b".,;:"), _class(b"!?"), _class(b"\n")


def statistics(c: tokens.Chunk) -> np.ndarray:
    """One row of STATS for each text of a chunk."""
    w = tokens.words(c)
    n = np.diff(w.first).astype(float)
    size = (c.stop - c.start).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[c.stop] - total[c.start]).astype(float)

    def per_words(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(a / np.maximum(b, 1))

    length = w.stop - w.start
    alpha = per_text(_ALPHA[c.data])
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][n > 0]] = False
    pairs = tokens.joined(w.hash, 2)
    distinct, again, longest = np.zeros(c.n), np.zeros(c.n), np.zeros(c.n)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(w.hash[a:b])
            distinct[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
            longest[i] = length[a:b].max()
        if b > a + 1:
            s = np.sort(pairs[a : b - 1])
            again[i] = np.count_nonzero(s[1:] == s[:-1])
    return np.stack([
        np.log1p(n), np.log1p(per_words(length) / np.maximum(n, 1)), np.log1p(longest), share(per_text(_UPPER[c.data]), alpha),
        share(per_text(_SYMBOL[c.data]), size), share(per_text(_BAR[c.data]), size), share(per_text(_DIGIT[c.data]), size), share(per_text(_STOP[c.data]), n),
        share(per_text(_SHOUT[c.data]), size), share(per_text(_LINE[c.data]), n), share(per_words(length <= 3), n), np.log1p(distinct) / np.log1p(np.maximum(n, 1)),
        share(per_words(same), n), share(again, n),
    ], axis=1)


def _statistics(batches):
    for b in batches:
        for c in tokens.chunks(b.column(2)):
            x = statistics(c)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n), rows], names=["id", "held_out", "x"])


def _moments(batches):
    """(label, x) -> (k, m): for each class the count, sums and cross products, cell by cell."""
    d = len(STATS)
    m = np.zeros((2, 1 + d + d * d))
    for b in batches:
        if not b.num_rows:
            continue
        y = b.column(0).to_numpy()
        x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
        for k in (0, 1):
            z = x[y == k]
            m[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["k", "m"])


class Discriminant:
    """Two shrunken normal densities with cached Cholesky factors."""

    def __init__(self, moments: np.ndarray, pooled: float = 0.1, ridge: float = 0.02):
        d = len(STATS)
        n, s, q = moments[:, 0], moments[:, 1 : 1 + d], moments[:, 1 + d :].reshape(2, d, d)
        self.alone = 0.5 if not n.sum() else float(n[1] > 0) if not n.all() else None
        if self.alone is not None:
            return
        mean = s / n[:, None]
        cov = np.stack([q[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
        all_ = (n[:, None, None] * cov).sum(axis=0) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(all_), 1e-8))
        self.mean = mean / self.scale
        unit = np.outer(self.scale, self.scale)
        self.inverse, self.log_norm = [], []
        for k in (0, 1):
            c = (1 - pooled) * cov[k] / unit + pooled * all_ / unit
            c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(low))
            self.log_norm.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.alone is not None:
            return np.full(len(x), self.alone)
        log = [self.log_norm[k] - 0.5 * (((x / self.scale - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _learn(stats: DataFrame, labels: DataFrame, pooled: float, ridge: float) -> Discriminant:
    rows = labels.select(F.col("id"), F.col("label").cast("int").alias("label")).where("label in (0, 1)").join(stats, "id").select("label", "x").mapInArrow(freeing(_moments), "k int, m double")
    moments = np.zeros(2 * (1 + len(STATS) + len(STATS) ** 2))
    for r in rows.groupBy("k").agg(F.sum("m").alias("m")).collect():
        moments[r.k] = r.m
    return Discriminant(moments.reshape(2, -1), pooled, ridge)


def _scorer(model, at: int):
    def run(batches):
        for b in batches:
            score = model.value.score(np.stack(b.column(at).to_numpy(zero_copy_only=False))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", pooled: float = 0.1, ridge: float = 0.02) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; held_out: crc32(id) mod 3 is 1, whose labels are not used."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(remainder(id_col, 3) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    stats = materialise(rows.mapInArrow(freeing(_statistics), f"id {id_type}, held_out boolean, x array<double>"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(remainder("id", 3) != 1)
    model = docs.sparkSession.sparkContext.broadcast(_learn(stats.select("id", "x"), known, pooled, ridge))
    out = stats.mapInArrow(freeing(_scorer(model, 2)), f"id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5, pooled: float = 0.1, ridge: float = 0.02) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `least`; trained as in quality_scores."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(remainder("id", 3) != 1)
    few = materialise(known)
    texts = docs.select(F.col(id_col).alias("id"), F.lit(False).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(few.select("id").distinct()) if few.count() <= 1_000_000 else few.select("id").distinct(), "id", "left_semi")
    stats = labelled.mapInArrow(freeing(_statistics), f"id {id_type}, held_out boolean, x array<double>").select("id", "x")
    model = docs.sparkSession.sparkContext.broadcast(_learn(stats, few, pooled, ridge))

    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *[model.value.score(statistics(c)) for c in tokens.chunks(text)]]))

    # only the text travels to Python; the other columns stay in the JVM
    docs = without(docs, [])
    return docs.where(text_udf("double", score)(F.col(text_col).cast("string")) >= least)
