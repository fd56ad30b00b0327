"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct letter words of a text and their leading 4 to 8 bytes
(so that inflected and compound forms count), known by hash.  A logistic model
over the telling ones is fitted with the loss

    mean log loss + l2 * |w|^2 + fair * mean over swaps of (w.x - w.x')^2

where x are the features of a labelled sentence that mentions an identity term
and x' those of the same sentence with every identity term replaced by another
one of its group, or by nothing: a score may hang neither on which group a
sentence mentions nor on its mentioning one, so neutral mentions stay unflagged
even where the labelled toxic sentences name some group more often than others.
Sentences end at . ! ? or a line break.

The groups are an argument: lists of terms for English, French, German and
Spanish (IDENTITY), and, in addition, groups found in the labelled rows
(``found_groups``): words that the labels say nothing about, yet that occur in
both classes, grouped by the word that they follow most often, so that the terms
of a group may stand in the same places.  Texts of any domain thus have neutral
mentions to swap; words that the labels do tell apart (slurs) are never swapped.

The vocabulary follows the data: of the features in at least ``min_texts`` toxic
texts it holds all whose log odds of being toxic are so many standard errors above
zero that chance alone would let in about ``noise`` of all features tested, and
those of the terms.  Features that speak against toxicity are left out on purpose:
benign padding must not pull a toxic text below the mark (README has figures).

The fit uses a bounded sample of labelled rows: all of them up to ``fit_rows``,
beyond that those whose id hashes below the matching fraction.  All their sentences
with terms count, in all their swaps: the penalty is a quadratic form of the weights,
so tasks sum its matrix, whose size is that of the terms' features, and no swap
reaches the driver.  Scoring covers every whole text, of any length, in one pass
without a shuffle.

Labels other than 0 and 1 are not learned from; with labels of one class only
the score is that class (0 or 1), with none 0.5.  Null texts are scored as empty
ones.  Repeated rows are all returned; ids may have any type; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import tokens
from assay.llm.common import freeing, materialise, remainder, small_batches
from assay.llm.tokens import U64

Groups = Sequence[Sequence[str]]

#: Groups of terms that may stand for each other in a counterfactual.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrant", "native"), ("immigrants", "natives"),
    ("african", "european", "american", "arab"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("fille", "garçon"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("immigrés", "autochtones"), ("africains", "européens", "américains", "arabes"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"), ("einwanderer", "einheimische"), ("afrikaner", "europäer", "amerikaner", "araber"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("chica", "chico"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"), ("inmigrantes", "nativos"), ("africanos", "europeos", "americanos", "árabes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Characters whose UTF-8 bytes make up the words of features.
_RUN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")

_BLANK = np.ones(256, bool)
_BLANK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PREFIX = range(4, 9)


def feature_sets(c: tokens.Chunk) -> list[np.ndarray]:
    """For each text its distinct features, ascending."""
    w = tokens.words(c, _BLANK)
    spans = tokens.Spans(c)
    hashes, owner = [w.hash], [w.text_of()]
    length = w.stop - w.start
    for k in _PREFIX:
        at = np.flatnonzero(length > k)
        hashes.append(spans.hash(w.start[at], w.start[at] + k) ^ U64(0x5555555555555555))
        owner.append(owner[0][at])
    h, o = np.concatenate(hashes), np.concatenate(owner)
    by = np.argsort(o, kind="stable")
    h, cuts = h[by], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=c.n))])
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def swaps(text: str, groups: Groups = IDENTITY) -> list[str]:
    """The text with all its identity terms replaced by their groups' next, second next, ... terms, and without them; none without such terms."""
    return _swapped(text, {t: (g, i) for g in groups for i, t in enumerate(g)})


def _swapped(text: str, place: dict[str, tuple[Sequence[str], int]]) -> list[str]:
    found = [(m.start(), m.end(), *place[m[0].lower()]) for m in _WORD.finditer(text) if m[0].lower() in place]
    if not found:
        return []
    out = []
    for turn in [*range(1, max(len(g) for _, _, g, _ in found)), None]:
        parts, at = [], 0
        for start, stop, g, i in found:
            parts += [text[at:start], "" if turn is None else g[(i + turn) % len(g)]]
            at = stop
        out.append("".join([*parts, text[at:]]))
    return out


def _word_counts(batches):
    """(label, text) -> (word, n1, n0): in how many texts of each class a lower-case word occurs, summed over a batch."""
    for b in batches:
        n = {0: Counter(), 1: Counter()}
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[label].update({m[0].lower() for m in _WORD.finditer(text or "")})
        words = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([n[k][w] for w in words], pa.int64()) for k in (1, 0)]], names=["word", "n1", "n0"])


def _before(wanted: set[str]):
    """(label, text) -> (word, before, n): how often each of the wanted words follows another word, summed over a batch."""

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for text in b.column(1).to_pylist():
                w = [m[0].lower() for m in _WORD.finditer(text or "")]
                n.update((x, y) for y, x in zip(w, w[1:], strict=False) if x in wanted)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([y for _, y in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "before", "n"])

    return run


def found_groups(labelled: DataFrame, n: dict[int, int], least: int = 20, share: float = 0.05, z: float = 1.0, size: int = 4) -> list[tuple[str, ...]]:
    """Groups of two to ``size`` words that the labels say nothing about: each is in at least ``least`` texts and a ``share``
    of all, in some of either class, at rates that differ by at most ``z`` standard errors, and most often follows the same
    word as the others of its group.  There are at most 1 / share as many such words as a text has distinct words on average."""
    seen = labelled.mapInArrow(freeing(_word_counts), "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p, q = F.col("n1") / n[1], F.col("n0") / n[0]
    both = (F.col("n1") + F.col("n0")) / (n[1] + n[0])
    error = F.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]))
    neutral = seen.where((F.least("n1", "n0") > 0) & (F.col("n1") + F.col("n0") >= max(least, share * (n[1] + n[0]))) & (F.abs(p - q) <= z * error))
    words = [r.word for r in neutral.orderBy(F.desc(F.col("n1") + F.col("n0")), "word").collect()]
    pairs = labelled.mapInArrow(freeing(_before(set(words))), "word string, before string, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    place = {r.word: r.before for r in pairs.groupBy("word").agg(F.max_by("before", F.struct("n", "before")).alias("before")).collect()}
    by: dict[str, list[str]] = {}
    for w in words:
        if w in place:
            by.setdefault(place[w], []).append(w)
    return [tuple(w[i : i + size]) for _, w in sorted(by.items()) for i in range(0, len(w), size) if len(w[i : i + size]) > 1]


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hash = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> U64(44)).astype(np.int64)] = True

    def find(self, features: np.ndarray) -> np.ndarray:
        near = features[self.seen[(features >> U64(44)).astype(np.int64)]]
        if not len(near) or not len(self.hash):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.hash, near)
        at[at == len(self.hash)] = 0
        return at[self.hash[at] == near]


def _frequent(batches):
    """(label, text) -> (feature, n): in how many of the texts each feature occurs."""
    for b in batches:
        sets = [s for c in tokens.chunks(b.column(1)) for s in feature_sets(c)]
        if sets:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])


class Swaps(NamedTuple):
    """Sum over n swaps of d d', d being +1 at each feature that a swap loses and -1 at each that it wins: values at places (row, column)."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int


def moments(pairs: dict[tuple[tuple[int, ...], tuple[int, ...]], int]) -> Swaps:
    """The matrix of swaps that lose and win such features, with the number of each."""
    by: dict[int, list] = {}
    for (lost, won), n in pairs.items():
        by.setdefault(len(lost) + len(won), []).append(((*lost, *won), len(lost), n))
    row, column, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, same in by.items():
        at = np.array([x for x, _, _ in same], np.int64).reshape(-1, k)
        sign = np.where(np.arange(k) < np.array([x for _, x, _ in same])[:, None], 1, -1)
        row.append(np.repeat(at, k, axis=1).ravel()), column.append(np.tile(at, (1, k)).ravel())
        value.append((np.repeat(sign, k, axis=1) * np.tile(sign, (1, k)) * np.array([x for _, _, x in same])[:, None]).ravel())
    r, c, v = np.concatenate(row), np.concatenate(column), np.concatenate(value)
    key, place = np.unique(r << 32 | c, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, v)
    return Swaps(key >> 32, key & 0xFFFFFFFF, total, sum(pairs.values()))


def objective(rows: list[np.ndarray], y: np.ndarray, swapped: Swaps, size: int, l2: float, fair: float):
    """x (weights, then the bias) -> the loss and its gradient; rows: each text's features."""
    at, col = np.repeat(np.arange(len(rows), dtype=np.int32), np.array([len(r) for r in rows], np.int64)), np.concatenate([np.zeros(0, np.int32), *rows])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = x[:-1], x[-1]
        z = np.bincount(at, w[col], minlength=len(rows)) + bias
        value = float(np.mean(np.logaddexp(0, z) - y * z) + l2 * (w @ w))
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        g = np.append(np.bincount(col, r[at], minlength=size) + 2 * l2 * w, r.sum())
        if swapped.n:
            pull = np.bincount(swapped.row, swapped.value * w[swapped.column], minlength=size) / swapped.n
            value += fair * float(w @ pull)
            g[:-1] += 2 * fair * pull
        return value, g

    return loss


class Linear:
    """Logistic regression over sparse 0/1 rows with the counterfactual penalty, by L-BFGS."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, swapped: Swaps, size: int, l2: float, fair: float, rounds: int = 200, memory: int = 12):
        loss = objective(rows, y, swapped, size, l2, fair)
        x = np.zeros(size + 1)
        x[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        value, g = loss(x)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            d, left = g.copy(), []
            for s, t in reversed(steps):
                left.append((s @ d) / (s @ t))
                d -= left[-1] * t
            if steps:
                s, t = steps[-1]
                d *= (s @ t) / (t @ t)
            for (s, t), a in zip(steps, reversed(left), strict=True):
                d += (a - (t @ d) / (s @ t)) * s
            rate = 1.0 if steps else 1 / max(1e-12, float(np.abs(g).sum()))
            slope = float(g @ d)
            for _ in range(30):
                new = x - rate * d
                v, h = loss(new)
                if v <= value - 1e-4 * rate * slope:
                    break
                rate /= 2
            else:
                break
            if (new - x) @ (h - g) > 1e-14:
                steps = [*steps[1 - memory :], (new - x, h - g)]
            done = value - v < 1e-9
            x, value, g = new, v, h
            if done:
                break
        self.weight, self.bias = x[:-1], float(x[-1])


class Model:
    def __init__(self, vocabulary: Vocabulary, linear: Linear | None, alone: float = 0.5, swaps: int = 0):
        self.vocabulary, self.linear, self.alone, self.swaps = vocabulary, linear, alone, swaps

    def score(self, c: tokens.Chunk) -> list[float]:
        if self.linear is None:
            return [self.alone] * c.n
        z = [self.linear.bias + float(self.linear.weight[self.vocabulary.find(s)].sum()) for s in feature_sets(c)]
        return [float(1 / (1 + np.exp(-min(40.0, max(-40.0, x))))) for x in z]


def _places(vocabulary):
    """(label, text) -> (label, the text's features as places of the vocabulary)."""

    def run(batches):
        for b in batches:
            places = [vocabulary.value.find(s).astype(np.int32) for c in tokens.chunks(b.column(1)) for s in feature_sets(c)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.list_(pa.int32()))], names=["label", "places"])

    return run


class Swapper:
    """The features that the swaps of a text's sentences lose and win; of each distinct word they are looked up once."""

    def __init__(self, vocabulary: Vocabulary, groups: Groups):
        self.vocabulary, self.term = vocabulary, {t: (g, i) for g in groups for i, t in enumerate(g)}
        self.places: dict[str, frozenset[int]] = {}
        self.longest: dict[str, int] = {}  # words with terms: the size of the largest group

    def _learn(self, words: set[str]) -> None:
        new = words - self.places.keys()
        for w in list(new):
            sizes = [len(self.term[m[0].lower()][0]) for m in _WORD.finditer(w) if m[0].lower() in self.term]
            if sizes:
                self.longest[w] = max(sizes)
                new.update(self.turned(w, t) for t in [*range(1, self.most), None])
        new = sorted(new)
        sets = (self.vocabulary.find(s) for c in tokens.chunks(pa.array(new, pa.string())) for s in feature_sets(c))
        self.places.update((w, frozenset(s.tolist())) for w, s in zip(new, sets, strict=True))

    @property
    def most(self) -> int:
        return max((len(g) for g, _ in self.term.values()), default=0)

    def turned(self, word: str, turn: int | None) -> str:
        """The word with the terms in it replaced by the ones ``turn`` places on in their groups, or left out."""

        def other(m: re.Match) -> str:
            if m[0].lower() not in self.term:
                return m[0]
            g, i = self.term[m[0].lower()]
            return "" if turn is None else g[(i + turn) % len(g)]

        return _WORD.sub(other, word)

    def count(self, text: str) -> Counter:
        """(lost, won) -> how many swaps of the text's sentences lose and win these features, both not empty together."""
        out: Counter = Counter()
        if len(self.places) > 200_000:  # looked up again where they are met again
            self.places.clear(), self.longest.clear()
        self._learn(set(_RUN.findall(text)))
        for sentence in _SENTENCE.finditer(text):
            words = set(_RUN.findall(sentence[0]))
            terms = [w for w in words if w in self.longest]
            if not terms:
                continue
            rest = frozenset().union(*(self.places[w] for w in words if w not in self.longest))
            have = frozenset().union(*(self.places[w] for w in terms))
            for turn in [*range(1, max(self.longest[w] for w in terms)), None]:
                new = frozenset().union(*(self.places[self.turned(w, turn)] for w in terms))
                lost, won = have - new - rest, new - have - rest
                if lost or won:
                    out[tuple(sorted(lost)), tuple(sorted(won))] += 1
        return out


def _swap_sums(vocabulary, groups: Groups):
    """(label, text) -> (row, column, value) of the matrix of the batch's swaps; their number at (-1, -1)."""

    def run(batches):
        swapper = Swapper(vocabulary.value, groups)
        for b in batches:
            found: Counter = Counter()
            for text in b.column(1).to_pylist():
                found.update(swapper.count(text or ""))
            m = moments(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)) for x, y in ((m.row, -1), (m.column, -1), (m.value, m.n))], names=["row", "column", "value"])

    return run


def fit(labelled: DataFrame, min_texts: int = 3, noise: float = 1.0, l2: float = 1e-5, fair: float = 1.0, groups: Groups = IDENTITY, find: bool = True) -> Model:
    """labelled: (label 0 or 1, text), a bounded sample; ``swaps`` of the model is how many counterfactuals changed a feature."""
    spark = labelled.sparkSession
    small_batches(spark)
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(Vocabulary(np.zeros(0, U64)), None, float(next(iter(n), 0.5)))
    if find:
        groups = [*groups, *found_groups(labelled, n)]
    counts = [labelled.where(F.col("label") == k).mapInArrow(freeing(_frequent), "feature long, n long").groupBy("feature").agg(F.sum("n").alias(f"n{k}")) for k in (1, 0)]
    # log odds of a text with the feature being of class 1, in standard deviations
    p, q = F.coalesce("n1", F.lit(0)) + 0.5, F.coalesce("n0", F.lit(0)) + 0.5
    odds = (F.log(p / (n[1] + 1.0 - p + 0.5)) - F.log(q / (n[0] + 1.0 - q + 0.5))) / F.sqrt(1.0 / p + 1.0 / q)
    tested = materialise(counts[0].where(F.col("n1") >= min_texts).join(counts[1], "feature", "left").select("feature", odds.alias("z")))
    mark = NormalDist().inv_cdf(1 - min(0.5, noise / max(1, tested.count())))
    best = tested.where(F.col("z") >= mark).select("feature").collect()
    terms = pa.array([t for g in groups for t in g], pa.string())
    named = [s for c in tokens.chunks(terms) for s in feature_sets(c)] if len(terms) else []
    vocabulary = Vocabulary(np.concatenate([np.array([r.feature for r in best], np.int64).view(U64), *named]))
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = labelled.mapInArrow(freeing(_places(shared)), "label int, places array<int>").toArrow()
    sums = labelled.mapInArrow(freeing(_swap_sums(shared, groups)), "row long, column long, value long").groupBy("row", "column").agg(F.sum("value").alias("value")).where("value <> 0").toArrow()
    r, c, v = (sums.column(k).to_numpy() for k in ("row", "column", "value"))
    swapped = Swaps(r[r >= 0], c[r >= 0], v[r >= 0], int(v[r < 0].sum()))
    linear = Linear(_split(rows.column("places"), np.int32), rows.column("label").to_numpy().astype(float), swapped, len(vocabulary.hash), l2, fair)
    return Model(vocabulary, linear, swaps=swapped.n)


def _split(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The lists of a list column, as arrays."""
    out = []
    for c in column.chunks:
        out += np.split(c.flatten().to_numpy().astype(kind), np.cumsum(c.value_lengths().to_numpy())[:-1]) if len(c) else []
    return out


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 40_000, **how) -> Model:
    """The model of the labelled rows whose crc32(id) mod 3 is not 1, about fit_rows at most."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(remainder("id", 3) != 1)
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # about fit_rows ids at most: 16 bytes each
    return fit(materialise(rows.join(F.broadcast(known), "id").select("label", "text")), **how)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 40_000, flag: float = 0.7, **how) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; held_out: crc32(id) mod 3 is 1, whose labels are not used."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, id_col, text_col, label_col, fit_rows, **how))

    def run(batches):
        for b in batches:
            score = [s for c in tokens.chunks(b.column(2)) for s in model.value.score(c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["id", "held_out", "score"])

    out = rows.mapInArrow(freeing(run), f"id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= flag).cast("int")).withColumnRenamed("id", id_col)
