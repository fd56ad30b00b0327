"""Spelling variants: words of a corpus that are one edit apart, grouped under their frequent form.

Words are counted by Spark over all texts.  Two words are *near* if one inserted,
deleted or replaced code point turns one into the other.  Near pairs come from
positional q-gram inverted indexes (q = 2) with a count filter:

Blocks.  For a pair whose shorter word has l code points, cut at l // 3 and
2 * l // 3.  One edit falls into one of these thirds, so the pair agrees in the two
others.  A word goes to a block for each third that it may leave open, as the
shorter of a pair or as the longer one: six rows a word, named by (l, third, what is
fixed).  Blocks, not grams, are what Spark shuffles: words that agree in two thirds
are few, whatever a suffix like "-tion" does, and a word without company is dropped
before anything is indexed.

Index.  In a block a word is its open third with one code point (or the word's
border) on either side.  Each of its bigrams is posted under (block, gram) with its
position.  The postings of a batch of blocks lie in one sorted array; for each word
the lists of its grams are merged, restricted to positions at most one apart and to
lengths l and l or l + 1, in one ordered pass over all (word, word) hits that counts
how often each pair is met: what a heap does entry by entry, for thousands of
words at once.  An open third of f code points has f + 1 such bigrams, and one edit
spoils at most two of them, so pairs with fewer than f - 1 hits are left out.

Verification.  Common prefix and suffix of the two words tell exactly whether they
are one edit apart, and which is the first third that could have been left open: a
pair counts in that block alone, so no pair is found twice.

Forms.  A word's form is its near word of largest count (ties: the smallest in
code-point order) if that count is ``ratio`` times its own at least.  Counts grow along
forms by that factor, so chains are short; roots come by pointer doubling, a join each.

Memory: a task holds an Arrow batch of blocks and one block more, and the hits of
some blocks at a time.  The of a word are bounded by its length and the alphabet.

Null and empty texts have no words; null ids count as empty; repeated rows count
again; ids may have any type; a text of any length is one row of work in the JVM;
other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ascii_lower, freeing, materialise, small_batches

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: Hits of postings that are merged at once.
HITS = 1 << 20


def misspelt(word: Column, doc: Column, one_in: int = 31) -> Column:
    """word, less one code point in those (document, word) pairs whose crc32 is a multiple of ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    short = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % one_in == 0, short).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased and their counts; noise: one in so many is misspelt on purpose."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0))
    # a run one shorter than asked for can't become longer
    found = docs.select(F.col(id_col).alias("doc"), F.explode(F.filter(runs, lambda w: F.length(w) >= least_chars)).alias("word"))
    if noise:
        found = found.select(misspelt(F.col("word"), F.col("doc"), noise).alias("word")).where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---- near pairs -----------------------------------------------------------------------------------


def _blocks(words: DataFrame) -> DataFrame:
    """(block, l, third, word, n): word as Latin-1 bytes, once for each third and each role."""
    size, word = F.length("word"), F.col("word")

    def rows(l: Column) -> list[Column]:
        a, b = F.floor(l / 3).cast("int"), F.floor(2 * l / 3).cast("int")
        start, end = lambda k: F.substring(word, F.lit(1), k), lambda k: F.substring(word, size - k + 1, k)
        fixed = [end(l - a), F.concat(start(a), end(l - b)), start(b)]
        return [F.struct(F.xxhash64(l, F.lit(k), x).alias("block"), l.alias("l"), F.lit(k).cast("byte").alias("third")) for k, x in enumerate(fixed)]

    every = F.array(*rows(size), *rows(size - 1))
    out = words.select(F.explode(every).alias("b"), F.encode("word", "ISO-8859-1").alias("word"), "n")
    return out.select("b.block", "b.l", "b.third", "word", "n")


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the numbers first[k] .. first[k] + count[k] - 1, and the k of each."""
    who = np.repeat(np.arange(len(count)), count)
    return np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), who


class Batch:
    """Rows of whole blocks, and the positional index of their bigrams."""

    def __init__(self, block: np.ndarray, l: np.ndarray, third: np.ndarray, words: pa.Array):
        self.block, self.l, self.third = np.cumsum(np.r_[False, block[1:] != block[:-1]]), l.astype(np.int64), third.astype(np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        self.data, self.first, self.size = np.frombuffer(words.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
        a, b = self.l // 3, 2 * self.l // 3
        # the open third: what is not fixed
        self.open = np.choose(self.third, [np.zeros_like(a), a, b])
        self.free = np.choose(self.third, [self.size - (self.l - a), self.size - (self.l - b) - a, self.size - b])

    def at(self, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Code point k of a row's word; 0 outside of it."""
        inside = (k >= 0) & (k < self.size[row])
        return np.where(inside, self.data[np.where(inside, self.first[row] + k, 0)], 0).astype(np.int64)

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(block, gram, position) as sorted numbers, and the row of each."""
        where, row = _spread(np.zeros(len(self.free), np.int64), self.free + 1)
        k = self.open[row] - 1 + where
        key = (self.block[row] << 47) | (self.at(row, k) << 39) | (self.at(row, k + 1) << 31) | where
        order = np.argsort(key, kind="stable")
        return key[order], row[order]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (shorter, longer or as long) that pass lengths, positions and the count filter."""
        key, row = self.postings()
        until = np.searchsorted(key, key + 1, "right")  # the same gram at this or the next position
        count = until - np.arange(len(key)) - 1
        # whole blocks at a time: all hits of a pair are counted together
        of = key >> 47
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, heads) if len(heads) else count
        piece = np.cumsum(total) // HITS
        cuts = np.r_[heads[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])], len(key)] if len(heads) else [0]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            met, i = _spread(np.arange(x, y) + 1, count[x:y])
            i, j = row[i + x], row[met]
            ok = (i != j) & (np.minimum(self.size[i], self.size[j]) == self.l[i]) & (np.abs(self.size[i] - self.size[j]) <= 1)
            i, j = i[ok], j[ok]
            swap = (self.size[i] > self.size[j]) | ((self.size[i] == self.size[j]) & (i > j))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            pair, hits = np.unique(i * len(self.l) + j, return_counts=True)  # the merge
            i, j = np.divmod(pair, len(self.l))
            ok = hits >= np.maximum(self.free[i], self.free[j]) - 1
            yield i[ok], j[ok]

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Length of the common prefix, or suffix, of words i and j; i is not the longer one."""
        out, left = np.zeros(len(i), np.int64), np.arange(len(i))
        k = 0
        while len(left):
            left = left[self.size[i[left]] > k]
            x, y = (r[left] for r in (i, j))
            same = self.at(x, self.size[x] - 1 - k) == self.at(y, self.size[y] - 1 - k) if back else self.at(x, np.full(len(x), k)) == self.at(y, np.full(len(y), k))
            left = left[same]
            out[left] += 1
            k += 1
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that are one edit apart, each in the first block where its words meet."""
        for i, j in self.candidates():
            front, back = self.common(i, j, False), self.common(i, j, True)
            l = self.l[i]
            one = (front + back >= l - (self.size[j] == l)) & ((self.size[j] > l) | (front < l))
            a, b = l // 3, 2 * l // 3
            home = np.select([back >= l - a, (front >= a) & (back >= l - b)], [0, 1], 2)
            ok = one & (home == self.third[i])
            yield i[ok], j[ok]


def _near(batches):
    """(block, l, third, word, n), sorted by block -> (word, near, near_n), both ways."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        block = t.column(0).to_numpy()
        head = np.r_[True, block[1:] != block[:-1]]
        alone = head & np.r_[head[1:], True]
        t = t.filter(pa.array(~alone)).combine_chunks()
        if not t.num_rows:
            return
        words, n = t.column(3).combine_chunks(), t.column(4).to_numpy()
        for i, j in Batch(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), words).pairs():
            if len(i):
                x, y = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
                yield pa.RecordBatch.from_arrays([words.take(x), words.take(y), pa.array(n[np.r_[j, i]])], names=["word", "near", "near_n"])

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        block = rest.column(0).to_numpy()
        last = np.flatnonzero(block != block[-1])
        if len(last):  # the last block may go on in the next batch
            yield from found(rest.slice(0, int(last[-1]) + 1))
            rest = rest.slice(int(last[-1]) + 1)
    if rest is not None:
        yield from found(rest)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for each two words of (word, n) that are one edit apart, both ways; words of code points up to U+00FF, distinct, from 7 code points on."""
    small_batches(words.sparkSession)
    dealt = _blocks(words).repartition("block").sortWithinPartitions("block")
    latin = dealt.mapInArrow(freeing(_near), "word binary, near binary, near_n long")
    return latin.select(F.decode("word", "ISO-8859-1").alias("word"), F.decode("near", "ISO-8859-1").alias("near"), "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow each other, by pointer doubling."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        to = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not now.join(to, "root", "left_semi").limit(1).count():
            return now
        now = materialise(now.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, noise: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of 7 code points and 2 occurrences at least."""
    words = materialise(vocabulary(docs, id_col, text_col, noise=noise))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.n") >= F.col("n") * ratio
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")
    )
    out = materialise(out)
    found = roots(out.where("form is not null"))
    return out.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
