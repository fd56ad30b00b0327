"""Language identification by rank-order n-gram profiles.

A profile is the list of the ``size`` most frequent letter n-grams (n = 1, 2, 3;
letters lower-cased, runs of anything else count as one blank, no n-gram spans
a blank) of all training texts of a language, ties in n-gram order.  A text's
own list is compared with every profile: the out-of-place distance adds up by
how many places each of the text's n-grams is off, ``size`` where it is missing.
The nearest language wins; ties go to the first in name order.  ``score`` is
(second - nearest) / second distance, 1 with only one language.

Whole texts are used in training and prediction.  Training counts are summed in
each task before they are shuffled; the driver gets ``size`` rows a language.

Null texts and texts without letters are ``und`` with score 0, and so is every
text if nothing was learned.  Rows without a language are not learned from.
Repeated rows count as often as they occur and are all returned.  Very long texts
are counted whole; ids may have any type.  An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm import tokens
from assay.llm.common import freeing, remainder, small_batches
from assay.llm.tokens import U64

SIZE = 300


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _grams(c: tokens.Chunk) -> list[np.ndarray]:
    """For each text the codes of its n-grams, in any order, with repetitions."""
    points = np.frombuffer(c.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    start, stop = at[c.start], at[c.stop]
    x = np.insert(_letters()[points], start, 0)  # a blank before each text
    first = start + np.arange(c.n)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[first] = True
    to = np.concatenate([[0], np.cumsum(keep)])
    begin, end = to[first], np.append(to[first[1:]], to[-1])
    x = np.append(x[keep], np.zeros(3, np.uint32)).astype(U64)
    one, two = x[:-3], (x[:-3] << U64(21)) | x[1:-2]
    three = (two << U64(21)) | x[2:-1]
    solid = x != 0
    ok1, ok2 = solid[:-3], solid[:-3] | solid[1:-2]
    ok3 = solid[1:-2]
    # n-grams of different n stay apart; the blank before the next text ends this one
    two, three = two | (U64(1) << U64(62)), three | (U64(1) << U64(63))
    none = np.zeros(0, U64)
    return [np.concatenate([one[a:b][ok1[a:b]], two[a:b][ok2[a:b]], three[a : b - 1][ok3[a : b - 1]]]) if b - a > 1 else none for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _ranked(codes: np.ndarray, size: int) -> np.ndarray:
    code, count = np.unique(codes, return_counts=True)
    return code[np.argsort(-count, kind="stable")[:size]]


def _count(batches):
    """(lang, text) -> (lang, gram, n), summed over as much of a task as fits."""
    held: dict[str, list] = {}

    def out():
        for lang, parts in held.items():
            code, count = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    size = 0
    for b in batches:
        langs = b.column(0).to_pylist()
        for c in tokens.chunks(b.column(1)):
            by: dict[str, list] = {}
            for lang, g in zip(langs[c.first : c.first + c.n], _grams(c), strict=True):
                by.setdefault(lang, []).append(g)
            for lang, gs in by.items():
                code, count = np.unique(np.concatenate(gs), return_counts=True)
                held.setdefault(lang, []).append((code, count.astype(np.int64)))
                size += len(code)
            if size > 2_000_000:
                held = {lang: [_sum(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1_000_000:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def _sum(parts):
    code = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts])
    u, at = np.unique(code, return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, count)
    return u, total


def profiles(train: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank): the profile of each language; gram packs the n-gram's code points."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(freeing(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").bitwiseXOR(F.lit(-(1 << 63))))
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Model:
    def __init__(self, rows, size: int):
        self.size = size
        self.langs = sorted({r.lang for r in rows})
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64).view(U64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for r in rows:
            self.rank[np.searchsorted(self.grams, np.array([r.gram], np.int64).view(U64)[0]), self.langs.index(r.lang)] = r.rank

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = _ranked(codes, self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        rank = self.rank[at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.langs[0], 1.0
        second = int(np.partition(far, 1)[1])
        return self.langs[best], float((second - far[best]) / second) if second else 0.0


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs; held_out: crc32(id) mod 4 is 2."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(profiles(train, lang_col, text_col, size).collect(), size))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [model.value.predict(g) for c in tokens.chunks(b.column(2)) for g in _grams(c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(freeing(run), f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
