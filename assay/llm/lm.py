"""Language-model scoring by deleted interpolation.

Tokens are words (A-Z lower-cased) and one end token a text; a text's first
context is the end token.  The ``heads`` most frequent words are classes of
their own; the other of the ``top`` most frequent words fall into classes by the
power of two of their rank; all remaining words, unseen ones too, are one class.

    Pc(w | v) = T(cw | cv) * P(w | cw),  T = l2 f(cw | cv) + l1 f(cw) + l0 / C
    P(w | v) = a f(w | v) + (1 - a) Pc(w | v)                     v not a head
    P(w | v) = T(cw | v) * [ a f(w | v, cw) + (1 - a) P(w | cw) ]     v a head

f are maximum-likelihood n-gram estimates, over classes in T (a head word's
class is the word itself, so between heads T is a word bigram) and over words in
the lines below it, whatever the words' ranks; P(w | cw) is (c + 1/2) / (sum of
c + 1/2 over the class, one unseen word in the last).  The weights l depend on
the bucket (power of two) of the context's frequency and are learned by
expectation-maximisation: counts from nine tenths of the training texts,
likelihood on the held-out tenth.  The weights a depend on the bucket of the
estimate's denominator, apart for head contexts, and are learned by leaving each
training occurrence out of its own counts; a is 0 where the denominator is 0.
Final counts are those of all training texts.

Three passes over the texts.  (1) Word counts: summed in each task, packed,
shuffled by word, all kept in a scratch table.  (2) Class pairs: a dense table
in each task, of at most (heads + 20)^2 cells whatever the corpus, summed in
slices.  (3) Scores: words among the ``top`` are looked up in a broadcast of
fixed size; the others travel packed to their word's bucket, where their
training counts are known exactly because all their occurrences meet (a word
this rare is in no bucket often), and partial sums travel back to the text.
Pairs of neighbours, unless both are heads (those have their cell in T), travel
the same way: to the pair's bucket if both words are among the ``top``, else to
that of the rare word; of two rare words to the first's and, with its count, on
to the second's.  No pair is more frequent than its rarer word, so none fills a
bucket.  A rare word after a known one is counted from its pair, others from an
entry of their own.  Texts are named by the numbers of their rows, in the order in
which a task reads them: it must read them in that order again if it is repeated,
as scans of files do.  Packs hold the steps from one number to the next.  In its
bucket a pair's count is known exactly; the ratio of f to the lower estimate goes
to a scratch table until the weights are known.

base_score is exact: sum over tokens of log10((c + 1/2) / (N + (V + 1) / 2)).
Null and empty texts have the end token only.  Rows with a null id are training
texts; ids may have any type.  Repeated rows are all counted, scored alike and
returned.  Very long texts are read whole, in chunks of bounded size.  An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assay.llm import tokens
from assay.llm.common import freeing, materialise, remainder, small_batches
from assay.llm.tokens import END, U64

HEADS, TOP = 1024, 1 << 18
_FLUSH = 4_000_000


# ---- pass 1: words --------------------------------------------------------------------------------

_PACK = "bucket int, words binary, counts binary"


def _planes(a: np.ndarray, k: int) -> bytes:
    """The lowest byte of all numbers, then the next one of all, k in all: those that are 0 throughout compress to nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as many bytes as the largest needs."""
    return _planes(a, max(1, (int(a.max()).bit_length() + 7) // 8))


def _wide(data, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<i8")[:, 0]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def _bucketed(h: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for the hashes of each bucket."""
    b = ((h >> U64(32)) % U64(n_buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=n_buckets))])
    for k in range(n_buckets):
        if cuts[k + 1] > cuts[k]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _count_words(n_buckets: int):
    def out(parts):
        h, n = _sum(parts)
        rows = [(k, h[at].tobytes(), _narrow(n[at])) for k, at in _bucketed(h, n_buckets)]
        for i in range(0, len(rows), 64):
            b, w, c = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(w, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "words", "counts"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for c in tokens.chunks(b.column(0)):
                h, n = np.unique(tokens.words(c).hash, return_counts=True)
                parts.append((np.append(h, END), np.append(n, c.n).astype(np.int64)))
                held += len(h)
            if held > _FLUSH:
                parts = [_sum(parts)]
                held = len(parts[0][0])
                if held > _FLUSH // 2:
                    yield from out(parts)
                    parts, held = [], 0
        if parts:
            yield from out(parts)

    return run


def _add_words(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for b in group:
        for w, c in zip(b.column("words"), b.column("counts"), strict=True):
            h = np.frombuffer(w.as_buffer(), U64)
            parts.append((h, _wide(c.as_buffer(), len(h))))
    if not parts:
        return
    h, n = _sum(parts)
    for i in range(0, len(h), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)].view(np.int64)), pa.array(n[i : i + (1 << 17)])], names=["word", "c"])


class Lexicon:
    """The most frequent words: hash, count and class of each, found through the hash's leading 18 bits."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, heads: int):
        rank = np.lexsort((words, -counts))
        cls = np.empty(len(words), np.int64)
        cls[rank] = np.arange(len(words))
        deep = cls >= heads
        cls[deep] = heads + np.log2(cls[deep] / heads + 1e-12).astype(np.int64)
        self.heads = heads
        self.rare = heads + 19
        self.classes = heads + 20
        by = np.argsort(words)
        self.hash, self.count, self.cls = words[by], counts[by], cls[by]
        self.n, self.v = n, v
        self.start = np.searchsorted(self.hash >> U64(46), np.arange((1 << 18) + 1, dtype=U64))
        self.end = int(np.searchsorted(self.hash, END)) if len(words) else 0
        self.has_end = self.end < len(words) and self.hash[self.end] == END
        self.z = n + 0.5 * (v + 1)
        mass = np.bincount(self.cls, self.count + 0.5, minlength=self.classes)
        mass[self.rare] = (n - self.count.sum()) + 0.5 * (v - len(words) + 1)
        self.inside = np.log10((self.count + 0.5) / mass[self.cls]) if len(words) else np.zeros(0)
        self.base = np.log10((self.count + 0.5) / self.z)
        self.rare_shift = math.log10(self.z / mass[self.rare]) if mass[self.rare] > 0 else 0.0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's place, or -1."""
        slot = (h >> U64(46)).astype(np.int64)
        at, stop = self.start[slot], self.start[slot + 1]
        found = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = self.hash[at[left]] == h[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return found

    def sequence(self, c: tokens.Chunk) -> tuple[tokens.Words, np.ndarray, np.ndarray, np.ndarray]:
        """A chunk's words, their places in the lexicon, and the classes of all contexts and tokens in order, end tokens included."""
        w = tokens.words(c)
        at = self.find(w.hash)
        cls = np.full(len(at) + 1, self.rare, np.int64)
        cls[:-1][at >= 0] = self.cls[at[at >= 0]]
        end = self.cls[self.end] if self.has_end else self.rare
        token = np.insert(cls[:-1], w.first[1:], end)  # an end token after each text
        context = np.concatenate([[end], token[:-1]])
        return w, at, context, token


# ---- pass 2: class pairs and weights --------------------------------------------------------------

_SLICES = 16


def _count_pairs(lexicon):
    def run(batches):
        lex = lexicon.value
        size = lex.classes * lex.classes
        held = np.zeros((2, size), np.int64)
        for b in batches:
            fold = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for c in tokens.chunks(b.column(0)):
                w, _, context, token = lex.sequence(c)
                code = context * lex.classes + token
                out = np.repeat(fold[c.first : c.first + c.n], np.diff(w.first) + 1)
                for k in (0, 1):
                    u, n = np.unique(code[out == bool(k)], return_counts=True)
                    held[k, u] += n
        step = -(-size // _SLICES)
        for s in range(_SLICES):
            part = held[:, s * step : (s + 1) * step]
            at = np.flatnonzero(part.any(axis=0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(at + s * step).tobytes()], pa.binary()), pa.array([part[:, at].tobytes()], pa.binary())], names=["slice", "code", "n"])

    return run


def _add_pairs(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, n, s = [], [], 0
    for b in group:
        for i in range(b.num_rows):
            s = b.column("slice")[i].as_py()
            code.append(np.frombuffer(b.column("code")[i].as_buffer(), np.int64))
            n.append(np.frombuffer(b.column("n")[i].as_buffer(), np.int64).reshape(2, -1))
        if len(code) > 32:
            code, n = _merged(code, n)
    code, n = _merged(code, n)
    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([code[0].tobytes()], pa.binary()), pa.array([n[0].tobytes()], pa.binary())], names=["slice", "code", "n"])


def _merged(code, n):
    u, at = np.unique(np.concatenate(code), return_inverse=True)
    every = np.concatenate(n, axis=1)
    return [u], [np.stack([np.bincount(at, every[k], minlength=len(u)).astype(np.int64) for k in (0, 1)])]


def bucket_of(context_counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(context_counts, 0) + 1.0).astype(np.int64)


def weights(kept: np.ndarray, held: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Interpolation weights (l0, l1, l2) for each bucket of context frequency, by EM: n-gram estimates from `kept`, likelihood of `held`, both C x C counts."""
    c = len(kept)
    context = kept.sum(axis=1)
    one = kept.sum(axis=0) / max(1, kept.sum())
    v, w = np.nonzero(held)
    n = held[v, w].astype(float)
    f = np.stack([np.full(len(v), 1 / c), one[w], kept[v, w] / np.maximum(context[v], 1)])
    b = bucket_of(context)[v]
    lam = np.tile(np.array([0.02, 0.49, 0.49]), (64, 1))
    lam[0] = (0.02, 0.98, 0.0)
    for _ in range(rounds):
        post = lam[b].T * f
        post *= n / post.sum(axis=0)
        for k in range(3):
            lam[:, k] = np.bincount(b, post[k], minlength=64) + (0.02, 0.49, 0.49)[k]
        lam /= lam.sum(axis=1, keepdims=True)
    return lam


def transitions(kept: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log10 of the interpolated class probabilities, C x C, from all counts."""
    lam = weights(kept, held)
    every = kept + held
    context = every.sum(axis=1)
    l0, l1, l2 = lam[bucket_of(context)].T
    # a context that was never seen has no two-class estimate: its weight goes to the one-class one
    l1, l2 = np.where(context == 0, l1 + l2, l1), np.where(context == 0, 0.0, l2)
    total = every.sum()
    one = every.sum(axis=0) / max(1, total)
    p = l0[:, None] / len(every) + (l1[:, None] * one if total else l1[:, None] / len(every)) + l2[:, None] * every / np.maximum(context, 1)[:, None]
    return np.log10(p)


# ---- pass 3: scores -------------------------------------------------------------------------------

#: kind: null of a text; 0 of rare words after rare ones; then of pairs of known words, a rare and a known, a known and a rare, two rare words.
_PARTS = "bucket int, rid long, id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, words binary, refs binary, texts binary, kind int"
_BOTH, _FIRST, _SECOND, _NONE = 1, 2, 3, 4
_LOW = U64(0xFFFFFFFF)
_PAIRS = 1_000_000


def _codes(key: np.ndarray) -> bytes:
    """Places of two known words, below 2^20 each, in five bytes: four of all entries, then the fifth of all."""
    code = (key >> U64(32)) << U64(20) | key & _LOW
    return code.astype(np.uint32).tobytes() + (code >> U64(32)).astype(np.uint8).tobytes()


def _of_codes(data) -> np.ndarray:
    n = data.size // 5
    code = np.frombuffer(data, np.uint32, n).astype(U64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(U64) << U64(32)
    return (code >> U64(20)) << U64(32) | code & U64((1 << 20) - 1)


def _texts(rid: np.ndarray, held: np.ndarray | None = None) -> bytes:
    """The ascending row numbers of entries and whether these are held out: the first number, then twice the step to each, and 1 if held out."""
    step = 2 * np.diff(rid, prepend=rid[:1])
    return rid[:1].tobytes() + _narrow(step if held is None else step + held)


def _of_texts(data, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row number of each entry, and whether it is of a training text."""
    step = _wide(data[8:], n)
    return np.frombuffer(data, np.int64, 1)[0] + np.cumsum(step >> 1), (step & 1) == 0


def _score(lexicon, table, n_buckets: int, id_type):
    names = ["bucket", "rid", "id", "held_out", "n_tokens", "n_known", "base", "score", "words", "refs", "texts", "kind"]

    def pairs(lex, w, at, context, token, rid, held):
        """(kind, key, the other word or null, text, held out) of a chunk's pairs, and of the rare words after rare ones: the others are in their pairs."""
        n = np.diff(w.first)
        place = np.insert(at, w.first[1:], lex.end if lex.has_end else -1)
        h = np.insert(w.hash, w.first[1:], END)
        before, h_before = np.roll(place, 1), np.roll(h, 1)  # the last token is an end token, and so is the first context
        who = np.repeat(np.arange(len(n)), n + 1)
        first, second = before >= 0, place >= 0
        go = ~((context < lex.heads) & (token < lex.heads))
        for kind, p in ((_BOTH, first & second & go), (_FIRST, ~first & second), (_SECOND, first & ~second), (_NONE, ~first & ~second)):
            p = np.flatnonzero(p)
            if len(p):
                key = (before[p].astype(U64) << U64(32)) | place[p].astype(U64) if kind == _BOTH else h[p] if kind == _SECOND else h_before[p]
                other = None if kind == _BOTH else place[p].astype(U64) if kind == _FIRST else before[p].astype(U64) if kind == _SECOND else h[p]
                yield kind, key, other, rid[who[p]], held[who[p]].astype(np.int64)
                if kind == _NONE and (p := p[h[p] != END]).size:
                    yield 0, h[p], None, rid[who[p]], held[who[p]].astype(np.int64)

    def pair_rows(found):
        for kind in sorted({x[0] for x in found}):
            key, other, rid, held = (np.concatenate(x) if x[0] is not None else None for x in list(zip(*[x for x in found if x[0] == kind], strict=True))[1:])
            rows = [(k, _codes(key[p]) if kind == _BOTH else key[p].tobytes(), None if other is None else other[p].tobytes() if kind == _NONE else _narrow(other[p]), _texts(rid[p], held[p])) for k, p in _bucketed(tokens.mix(key) if kind == _BOTH else key, n_buckets)]
            for i in range(0, len(rows), 64):
                k, words, others, texts = zip(*rows[i : i + 64], strict=True)
                m = len(k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(k, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.int64())] * 2,
                    *[pa.nulls(m, pa.float64())] * 2, pa.array(words, pa.binary()), pa.array(others, pa.binary()), pa.array(texts, pa.binary()), pa.array([kind] * m, pa.int32()),
                ], names=names)

    def run(batches):
        lex, logp = lexicon.value, table.value
        found, waiting = [], 0
        for b in batches:
            rid_all, held_all = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for c in tokens.chunks(b.column(3)):
                rid, held = rid_all[c.first : c.first + c.n], held_all[c.first : c.first + c.n]
                w, at, context, token = lex.sequence(c)
                n = np.diff(w.first)
                text = w.text_of()
                known = at >= 0
                has_end = lex.has_end
                end_base, end_in = (lex.base[lex.end], lex.inside[lex.end]) if has_end else (math.log10(0.5 / lex.z), math.log10(0.5 / lex.z) + lex.rare_shift)
                base = np.bincount(text[known], lex.base[at[known]], minlength=c.n) + end_base
                score = np.bincount(np.repeat(np.arange(c.n), n + 1), logp[context, token], minlength=c.n)
                score += np.bincount(text[known], lex.inside[at[known]], minlength=c.n) + end_in
                rare = np.bincount(text[~known], minlength=c.n)
                score += rare * lex.rare_shift
                yield pa.RecordBatch.from_arrays([
                    pa.array((rid % n_buckets).astype(np.int32)), pa.array(rid), b.column(1).slice(c.first, c.n), pa.array(held), pa.array(n + 1), pa.array(n - rare + int(has_end)),
                    pa.array(base), pa.array(score), *[pa.nulls(c.n, pa.binary())] * 3, pa.nulls(c.n, pa.int32()),
                ], names=names)
                for x in pairs(lex, w, at, context, token, rid, held):
                    found.append(x)
                    waiting += len(x[1])
                if waiting >= _PAIRS:
                    yield from pair_rows(found)
                    found, waiting = [], 0
        yield from pair_rows(found)

    return run


def pair_ratio(c: np.ndarray, d: np.ndarray, lower: np.ndarray, cw: np.ndarray, head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs with count c, denominator d, log10 of the lower estimate and the second word's count: (ratio of c/d to the lower
    estimate, number of the weight, cell of the histogram of ratios with one occurrence left out, or -1, and that cell's occurrences)."""
    kind = np.where(head, 0, 64)
    below = 10.0**lower
    ratio = np.where(d > 0, c / np.maximum(d, 1), 0.0) / below
    left = (c - 1) / np.maximum(d - 1, 1) / below * (cw + 0.5) / np.maximum(cw - 0.5, 0.5)
    cell = np.clip(128 + 4 * np.log2(np.maximum(left, 1e-30)), 1, 255).astype(np.int64)
    cell = (kind + bucket_of(d - 1)) * 256 + np.where(left > 0, cell, 0)
    return ratio.astype(np.float32), (kind + bucket_of(d)).astype(np.uint8), np.where((c > 0) & (d > 1), cell, -1), c


def pair_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The weight a for each bucket of denominators (from 64 on: of contexts that are not heads), by EM on the histogram of ratios."""
    k, j = np.divmod(cells, 256)
    r = np.where(j > 0, 2.0 ** ((j + 0.5 - 128) / 4), 0.0)
    a = np.full(128, 0.5)
    for _ in range(rounds):
        up = a[k] * r
        a = (np.bincount(k, n * up / (up + 1 - a[k]), minlength=128) + 0.5) / (np.bincount(k, n, minlength=128) + 1)
    a[[0, 64]] = 0.0
    return a


#: kind: null of a text, 0 of sums, 1 of ratios, 2 of a histogram, 3 of pairs for the second word's bucket, 4 of words with their counts.
_BACK = "home int, rid long, id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, sums binary, more binary, kind int"


def _packs(home, sums, more, kind: int, id_type) -> pa.RecordBatch:
    m = len(home)
    return pa.RecordBatch.from_arrays([
        pa.array(home, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2,
        pa.array(sums, pa.binary()), pa.array(more, pa.binary()), pa.array([kind] * m, pa.int32()),
    ], names=["home", "rid", "id", "held_out", "n_tokens", "n_known", "base", "score", "sums", "more", "kind"])


def _ratios(rid: np.ndarray, at: np.ndarray, ratio, weight, id_type) -> Iterator[pa.RecordBatch]:
    """Packs of the entries' ratios, ordered by text; at: each entry's place in ratio and weight."""
    order = np.argsort(rid, kind="stable")
    for i in range(0, len(order), 1 << 18):
        p = order[i : i + (1 << 18)]
        yield _packs([0], [_texts(rid[p])], [ratio[at[p]].tobytes() + weight[at[p]].tobytes()], 1, id_type)


def _histogram(cell: np.ndarray, n: np.ndarray, id_type) -> Iterator[pa.RecordBatch]:
    if (cell >= 0).any():
        n = np.bincount(cell[cell >= 0], n[cell >= 0]).astype(np.int64)
        yield _packs([0], [np.flatnonzero(n).tobytes()], [n[n > 0].tobytes()], 2, id_type)


def _rare(lexicon, table, within, n_buckets: int, id_type):
    """within: training pairs of each head and each class that is not a head."""
    names = ["home", "rid", "id", "held_out", "n_tokens", "n_known", "base", "score", "sums", "more", "kind"]

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, logp, inner = lexicon.value, table.value, within.value
        z, rare, heads = lex.z, lex.rare, lex.heads
        words, texts, train = [], [], []
        pairs: dict[int, list] = {k: [] for k in (_BOTH, _FIRST, _SECOND, _NONE)}
        for b in group:
            packed = b.column("words").is_valid()
            docs = b.filter(pa.array(~packed.to_numpy(zero_copy_only=False)))
            if docs.num_rows:
                m = docs.num_rows
                yield pa.RecordBatch.from_arrays([docs.column("bucket"), *[docs.column(x) for x in names[1:8]], *[pa.nulls(m, pa.binary())] * 2, pa.nulls(m, pa.int32())], names=names)
            for i in np.flatnonzero(packed.to_numpy(zero_copy_only=False)):
                kind = b.column("kind")[i].as_py()
                data = b.column("words")[i].as_buffer()
                h = _of_codes(data) if kind == _BOTH else np.frombuffer(data, U64)
                rid, ok = _of_texts(b.column("texts")[i].as_buffer(), len(h))
                if kind:
                    refs = b.column("refs")[i].as_buffer() if kind != _BOTH else None
                    pairs[kind].append((h, None if kind == _BOTH else np.frombuffer(refs, U64) if kind == _NONE else _wide(refs, len(h)), rid, ok))
                if kind in (0, _SECOND):
                    words.append(h), texts.append(rid), train.append(ok)
        rare_words, rare_counts = np.zeros(0, U64), np.zeros(0, np.int64)
        if words:
            h, t, ok = np.concatenate(words), np.concatenate(texts), np.concatenate(train)
            rare_words, at = np.unique(h, return_inverse=True)
            rare_counts = np.bincount(at, ok).astype(np.int64)
            c = rare_counts[at]
            rid, at = np.unique(t, return_inverse=True)
            base = np.bincount(at, np.log10((c + 0.5) / z))
            known = np.bincount(at, c > 0)
            rows = [(k, _texts(rid[p]), base[p].tobytes() + _planes(known[p].astype(np.int64), 4)) for k, p in _homes(rid, n_buckets)]
            k, sums, more = zip(*rows, strict=True)
            yield _packs(k, sums, more, 0, id_type)
            slot = ((rare_words[0] >> U64(32)) % U64(n_buckets)).astype(int)
            yield _packs([slot], [rare_words.tobytes()], [rare_counts.tobytes()], 4, id_type)
        words, texts, train = [], [], []

        if pairs[_BOTH]:
            key, _, rid, ok = (np.concatenate(x) if x[0] is not None else None for x in zip(*pairs.pop(_BOTH), strict=True))
            u, at = np.unique(key, return_inverse=True)
            c = np.bincount(at, ok, minlength=len(u))
            v, w = (u >> U64(32)).astype(np.int64), (u & _LOW).astype(np.int64)
            cv, cw = lex.cls[v], lex.cls[w]
            head = cv < heads
            d = np.where(head, inner[np.minimum(cv, heads - 1), np.maximum(cw - heads, 0)], lex.count[v])
            ratio, weight, cell, n = pair_ratio(c, d, lex.inside[w] + np.where(head, 0.0, logp[cv, cw]), lex.count[w], head)
            yield from _ratios(rid, at, ratio, weight, id_type)
            yield from _histogram(cell, n, id_type)
            del key, rid, ok, u, at, c, ratio, weight
        if pairs[_SECOND]:
            key, other, rid, ok = map(np.concatenate, zip(*pairs[_SECOND], strict=True))
            at, (h, v), c = _unique(key, other, ok)
            cw = rare_counts[np.searchsorted(rare_words, h)] if len(rare_words) else np.zeros(len(h), np.int64)
            cv = lex.cls[v.astype(np.int64)]
            head = cv < heads
            d = np.where(head, inner[np.minimum(cv, heads - 1), rare - heads], lex.count[v.astype(np.int64)])
            ratio, weight, cell, n = pair_ratio(c, d, np.log10((cw + 0.5) / z) + lex.rare_shift + np.where(head, 0.0, logp[cv, rare]), cw, head)
            yield from _ratios(rid, at, ratio, weight, id_type)
            yield from _histogram(cell, n, id_type)
        if pairs[_FIRST] or pairs[_NONE]:
            first, at = np.unique(np.concatenate([x[0] for k in (_FIRST, _NONE) for x in pairs[k]]), return_inverse=True)
            follow = np.bincount(at, np.concatenate([x[3] for k in (_FIRST, _NONE) for x in pairs[k]]))
            for kind in (_FIRST, _NONE):
                if not pairs[kind]:
                    continue
                key, other, rid, ok = map(np.concatenate, zip(*pairs[kind], strict=True))
                at, (h, w), c = _unique(key, other, ok)
                d = follow[np.searchsorted(first, h)]
                if kind == _FIRST:
                    w = w.astype(np.int64)
                    ratio, weight, cell, n = pair_ratio(c, d, logp[rare, lex.cls[w]] + lex.inside[w], lex.count[w], False)
                    yield from _ratios(rid, at, ratio, weight, id_type)
                    yield from _histogram(cell, n, id_type)
                    continue
                # a pair goes on once, with its texts
                dealt = list(_bucketed(w, n_buckets))
                place = np.empty(len(h), np.int64)
                place[np.concatenate([p for _, p in dealt])] = np.arange(len(h))
                order, size, done = np.argsort(place[at], kind="stable"), np.bincount(at, minlength=len(h)), 0
                for k, p in dealt:
                    rows = order[done : done + int(size[p].sum())]
                    done += len(rows)
                    yield _packs([k], [_planes(np.concatenate([w[p].view(np.int64), c[p].astype(np.int64), d[p].astype(np.int64), size[p]]), 8)], [_narrow(rid[rows])], 3, id_type)

    return run


def _homes(rid: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    home = rid % n_buckets
    order = np.argsort(home, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=n_buckets))])
    for k in range(n_buckets):
        if cuts[k + 1] > cuts[k]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _unique(key: np.ndarray, other: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Each entry's place among the different (key, other), these, and how many entries of each are ok."""
    order = np.lexsort((other, key))
    k, o = key[order], other[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, (k[new], o[new]), np.bincount(at, ok)


def _second(lexicon, table, id_type):
    """Pairs of two rare words, in the second one's bucket."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, logp = lexicon.value, table.value
        known, pairs = [], []
        for b in group:
            for i in range(b.num_rows):
                sums, more = b.column("sums")[i].as_buffer(), b.column("more")[i].as_buffer()
                if b.column("kind")[i].as_py() == 4:
                    known.append((np.frombuffer(sums, U64), np.frombuffer(more, np.int64)))
                else:
                    x = _wide(sums, sums.size // 8).reshape(4, -1)
                    pairs.append((*x, _wide(more, int(x[3].sum()))))
        if not pairs:
            return
        w, c, d, n, rid = map(np.concatenate, zip(*pairs, strict=True))
        h, cw = _sum(known) if known else (np.zeros(0, U64), np.zeros(0, np.int64))
        w = w.view(U64)
        place = np.minimum(np.searchsorted(h, w), max(0, len(h) - 1))
        cw = np.where(h[place] == w, cw[place], 0) if len(h) else np.zeros(len(w), np.int64)
        ratio, weight, cell, m = pair_ratio(c, d, np.log10((cw + 0.5) / lex.z) + lex.rare_shift + logp[lex.rare, lex.rare], cw, False)
        yield from _ratios(rid, np.repeat(np.arange(len(w)), n), ratio, weight, id_type)
        yield from _histogram(cell, m, id_type)

    return run


def _cells(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column(c)[i].as_buffer(), np.int64)) for c in (0, 1)], names=["cell", "n"])


def _weighed(a: np.ndarray, n_buckets: int, id_type):
    """Packs of ratios -> sums of log10(1 - a + a * ratio) for each text."""

    def run(batches):
        for b in batches:
            rids, sums = [], []
            for i in range(b.num_rows):
                more = b.column("more")[i].as_buffer()
                m = more.size // 5
                rid, _ = _of_texts(b.column("sums")[i].as_buffer(), m)
                at = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
                k = a[np.frombuffer(more, np.uint8, m, 4 * m)]
                rids.append(rid[at]), sums.append(np.add.reduceat(np.log10(1 - k + k * np.frombuffer(more, np.float32, m)), at))
            if rids:
                rid, at = np.unique(np.concatenate(rids), return_inverse=True)
                total = np.bincount(at, np.concatenate(sums))
                k, packed, more = zip(*[(k, _texts(rid[p]), total[p].tobytes()) for k, p in _homes(rid, n_buckets)], strict=True)
                yield _packs(k, packed, more, 1, id_type)

    return run


def _together(id_type):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, ratios = [], [], []
        for b in group:
            packed = b.column("sums").is_valid().to_numpy(zero_copy_only=False)
            docs.append(b.filter(pa.array(~packed)))
            for i in np.flatnonzero(packed):
                sums, more = b.column("sums")[i].as_buffer(), b.column("more")[i].as_buffer()
                if b.column("kind")[i].as_py() == 1:
                    ratios.append((_of_texts(sums, more.size // 8)[0], np.frombuffer(more, np.float64)))
                else:
                    m = more.size // 12
                    parts.append((_of_texts(sums, m)[0], np.frombuffer(more, np.float64, m), _wide(more[8 * m :], m)))
        if not any(d.num_rows for d in docs):
            return
        t = pa.Table.from_batches(docs).combine_chunks()
        row = t.column("rid").to_numpy()
        order = np.argsort(row)
        base, known, pairs = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row))
        if ratios:
            rid, total = map(np.concatenate, zip(*ratios, strict=True))
            pairs = np.bincount(order[np.searchsorted(row, rid, sorter=order)], total, minlength=len(row))
        if parts:
            rid, b, k = map(np.concatenate, zip(*parts, strict=True))
            place = order[np.searchsorted(row, rid, sorter=order)]
            base, known = np.bincount(place, b, minlength=len(row)), np.bincount(place, k, minlength=len(row))
        known = known.astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            t.column("id").combine_chunks(), t.column("held_out").combine_chunks(), t.column("n_tokens").combine_chunks(), pa.array(t.column("n_known").to_numpy() + known),
            pa.array(t.column("base").to_numpy() + base), pa.array(t.column("score").to_numpy() + base + pairs),
        ], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heads: int = HEADS, top: int = TOP) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; held_out: crc32(id) mod 5 is 1."""
    if top >= 1 << 20:
        raise ValueError("top must be below 2^20")
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a partition each, so even without more buckets than partitions
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = F.coalesce(remainder(id_col, 5) == 1, F.lit(False))
    fold = F.coalesce(F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 5) % 10 == 0, F.lit(False))
    train = docs.where(~held)

    words = train.select(text.alias("text")).mapInArrow(freeing(_count_words(n_buckets)), _PACK)
    words = materialise(words.repartitionById(n_buckets, "bucket").mapInArrow(freeing(_add_words), "word long, c long"))
    # the count from which on at most `top` words remain, by sixteenths of a power of two
    grade = F.floor(16 * F.log2("c")).cast("int")
    steps = sorted(words.groupBy(grade.alias("g")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.g)
    least, room = None, top
    for r in steps:
        room -= r.v
        if room < 0:
            break
        least = r.least
    n, v = sum(r.n for r in steps), sum(r.v for r in steps)
    best = words.where((F.col("c") >= least if least is not None else F.lit(False)) | (F.col("word") == int(END))).toArrow()
    w, c = best.column("word").to_numpy().view(U64), best.column("c").to_numpy()
    lexicon = Lexicon(np.ascontiguousarray(w), np.ascontiguousarray(c), n, v, heads)
    lex = sc.broadcast(lexicon)

    pairs = train.select(text.alias("text"), fold.alias("fold")).mapInArrow(freeing(_count_pairs(lex)), "slice int, code binary, n binary")
    counts = np.zeros((2, lexicon.classes * lexicon.classes), np.int64)
    for r in pairs.groupBy("slice").applyInArrow(_add_pairs, "slice int, code binary, n binary").collect():
        counts[:, np.frombuffer(bytes(r.code), np.int64)] = np.frombuffer(bytes(r.n), np.int64).reshape(2, -1)
    shape = (lexicon.classes, lexicon.classes)
    table = sc.broadcast(transitions(counts[0].reshape(shape), counts[1].reshape(shape)))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), held.alias("held_out"), text.alias("text"))
    parts = rows.mapInArrow(freeing(_score(lex, table, n_buckets, arrow_id)), _PARTS.format(id=id_type))
    back = _BACK.format(id=id_type)
    within = sc.broadcast(counts.sum(axis=0).reshape(shape)[:heads, heads:])
    first = materialise(parts.repartitionById(n_buckets, "bucket").mapInArrow(freeing(_rare(lex, table, within, n_buckets, arrow_id)), back))
    second = materialise(first.where("kind in (3, 4)").repartitionById(n_buckets, "home").mapInArrow(freeing(_second(lex, table, arrow_id)), back))
    both = first.where("kind in (1, 2)").unionByName(second)
    cells = both.where("kind = 2").select("sums", "more").mapInArrow(freeing(_cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    a = pair_weights(np.array([r.cell for r in cells], np.int64), np.array([r.n for r in cells], float))
    back = first.where("kind is null or kind = 0").unionByName(both.where("kind = 1").mapInArrow(freeing(_weighed(a, n_buckets, arrow_id)), back))
    out = back.repartitionById(n_buckets, "home").mapInArrow(freeing(_together(arrow_id)), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
