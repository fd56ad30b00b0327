"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Documents are sets of distinct four-word shingles; two link when
100 * |A & B| >= 85 * |A | B| (both are arguments; the figures below are those
of 85/100, derived from the argument in the code).  Equal sets are one *class*.  All links between
classes are found, none by chance:

Tiles.  Sizes are cut into bands (6-11, 12-23, ...).  If A and B link and A, the
smaller, is in a band that ends below U, then A and B differ in at most
d = 15/85 * (U-1) shingles.  The hash space is cut into m = d + 1 + slack
slices, so A and B hold exactly the same shingles in at least 1 + slack of them.
A class therefore goes to one tile for each slice it has shingles in, named by
band, slice and the slice's content.  (A class with so many empty slices that
this would prove nothing, a few in a thousand, also goes to the tiles of its
smallest 15 % shingles; two such classes meet there by the prefix principle.)
A class goes to the tiles of the band below, too, if a partner there is possible.

Bitmaps.  Each class has a parity bitmap of 64 to 4096 bits by its size; the
number of bits in which two differ bounds the symmetric difference from below
and so the overlap from above.  Pairs that pass sizes and bitmaps are verified
on the sorted shingle arrays.

Groups.  Members of a tile are first paired with its most connected class only
(the one whose tiles have most members: the text that the others are edits of
shares more slices than any edit does), so a group of near copies costs one pair
for each member; verified links make components.  Only where an unverified pair
leaves two components in one tile are pairs across components compared, in
blocks of 256 x 256 members, bitmaps first: only survivors leave a block.  A
tile with more than CROWD members in several components (many edits of one text,
or texts that share a passage) is not compared at all.  Its members meet again by
the prefix principle: in any order of shingles that two texts share, of a pair
that links each has one of the other's among its first floor(n * (1 - least)) + 1.
The order here puts shingles that a centre does not hold first, then goes by hash;
a tile's centre is the one of its component that leads most crowded tiles.  A text that is no copy of the centre fills its prefix
with shingles of its own, so it meets those only that share its own edits.
Prefixes travel packed, as tiles do, and a shingle that one member alone has is
dropped before it becomes a row.

Pairs are verified with their sets side by side.  The second of a pair may be
the centre of a large group, so pairs are dealt by it and a salt: its set is sent
once for each SALT pairs, and no task gets all pairs of a centre.

Tiles travel as packed arrays (6 bytes an entry) in one shuffle; a map task
forwards a tile's name once and writes its other members beside it, so a tile
that a third of all documents share does not meet in one task.

Result: (id, n_shingles, component_id), a row for each input row; component_id
is the smallest id among the documents reachable by links.  Ids may have any
type that Spark can order.  Null and empty texts have no shingles and link with
nothing.  A null id takes part in links and gets its component's smallest
non-null id, or null.  Repeated rows (or texts) are one class.  A text of any
length is one row of work; Arrow batches are bounded in bytes.  Other columns
are ignored, whatever their names; an empty table gives an empty result.

``one_each`` keeps one row of each component and every row without shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import tokens
from assay.llm.common import buckets, components, freeing, materialise, shielded, small_batches, without
from assay.llm.tokens import U64

#: Words in a shingle, and the least similarity as a fraction, unless given.
SHINGLE, NUM, DEN = 4, 85, 100
#: A least similarity: numerator and denominator.
Least = tuple[int, int]
#: Members on each side of a block in which all pairs are compared.
BLOCK = 256
#: Members from which on a tile with several components is taken by its members' prefixes.
CROWD = 128
#: Pairs of one centre that are verified together.
SALT = 64
#: Tile entries that a map task gathers before it packs them, and classes that a task remembers.
FLUSH, KNOWN = 250_000, 100_000


def links(a: np.ndarray, b: np.ndarray, shared: np.ndarray, least: Least) -> np.ndarray:
    num, den = least
    return den * shared >= num * (a + b - shared)


def _bands(n: int, least: Least) -> list[tuple[int, int, int]]:
    """(number, most differences, slices) of the bands in which a set of n shingles looks for partners."""
    num, den = least
    low = -(-num // (den - num))
    if n < low:
        return []  # it links with equal sets only
    k = (n // low).bit_length() - 1
    out = []
    for j in (k, k - 1):
        if j < 0 or j < k and -(-num * n // den) >= low << k:
            continue
        most = (low << (j + 1)) - 1
        d = (den - num) * most // num
        out.append((j, d, d + 2 + d // 8))
    return out


def tiles(s: np.ndarray, least: Least) -> np.ndarray:
    """Names of the tiles of a set (distinct hashes, ascending)."""
    names = []
    for band, d, m in _bands(len(s), least):
        where = ((s >> U64(32)) * U64(m)) >> U64(32)
        at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        content = np.add.reduceat(tokens.mix(s), at)
        names.append(tokens.mix(content + where[at] * U64(0x9E3779B97F4A7C15) + U64(band + 1)))
        if m - len(at) >= m - d:
            prefix = len(s) - -(-least[0] * len(s) // least[1]) + 1
            names.append(tokens.mix(s[:prefix] + U64(0xABCD) * U64(band + 1)))
    return np.concatenate(names) if names else np.zeros(0, U64)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod width is flipped for each h.  Two to four bits for a shingle, so that few differences cancel out."""
    width = 1 << min(12, max(6, int(len(s)).bit_length() + 1))
    odd = np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps (as 64-bit words) at a smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, least: Least) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can link."""
    return links(na, nb, (na + nb - np.maximum(differ, np.abs(na - nb))) // 2, least)


# ---- pass over the texts: classes, bitmaps, tiles -------------------------------------------------

_PACKED = "bucket int, kind int, data binary, members binary"


def shortened(names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Names as they travel: their bucket and 32 bits."""
    return (((names >> U64(32)) % U64(n_buckets)) << U64(32)) | (names & U64(0xFFFFFFFF))


def packed(names: list[np.ndarray], classes: list[int], n_buckets: int) -> pa.RecordBatch:
    """Rows (bucket, kind, data, members) of the names of some classes: kind 1: (name, class) of a bucket; 2: (name, class) of groups met here."""
    lens = [len(x) for x in names]
    key, cls = np.concatenate([np.zeros(0, U64), *names]), np.repeat(np.array(classes, np.int64), lens)
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    rows: dict[str, list] = {"bucket": [], "kind": [], "data": [], "members": []}
    if len(key):
        keep = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls = key[keep], cls[keep]
        head = np.r_[True, key[1:] != key[:-1]]
        shared = np.zeros(len(key), bool)
        shared[:-1] |= ~head[1:]
        shared |= ~head
        k, c = shortened(key[shared], n_buckets), cls[shared]  # groups: written as they are
        for i in range(0, len(k), 65536):
            rows["bucket"].append(int(c[i] % n_buckets)), rows["kind"].append(2)
            rows["data"].append(k[i : i + 65536].tobytes()), rows["members"].append(c[i : i + 65536].tobytes())
        # a name's first class goes on, marked if the name has a group already
        k, c, m = key[head], cls[head], shared[head]
        b = (k >> U64(32)) % U64(n_buckets)
        order = np.argsort(b, kind="stable")
        k, c, m, b = k[order], c[order], m[order], b[order].astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for x, y in zip(cuts, np.r_[cuts[1:], len(b)], strict=True):
            who, at = np.unique(c[x:y], return_inverse=True)
            wide = np.uint16 if len(who) <= 0x7FFF else np.uint32
            mark = wide(0x8000) if wide is np.uint16 else wide(0x80000000)
            rows["bucket"].append(int(b[x])), rows["kind"].append(1)
            rows["data"].append(k[x:y].astype(np.uint32).tobytes() + (at.astype(wide) | np.where(m[x:y], mark, wide(0))).astype(wide).tobytes())
            rows["members"].append(who.tobytes())
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "data": pa.binary(), "members": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(rows[k], v) for k, v in kinds.items()], names=list(kinds))


def unpacked(bucket: int, kind: int, data: pa.Buffer, members: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shortened names, classes, marks) of a packed row."""
    who = np.frombuffer(members, np.int64)
    if kind == 2:
        return np.frombuffer(data, U64), who, np.ones(len(who), bool)
    wide, size = (np.uint16, 6) if len(who) <= 0x7FFF else (np.uint32, 8)
    n = data.size // size
    at = np.frombuffer(data, wide, n, 4 * n)
    top = wide(1 << (8 * wide().itemsize - 1))
    return (U64(bucket) << U64(32)) | np.frombuffer(data, np.uint32, n).astype(U64), who[at & wide(top - 1)], (at & top) != 0


def in_groups(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(name, class) of those names of a bucket that several classes have here, or that are marked; all others are dropped."""
    key, cls, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, cls, mark = key[order], cls[order], mark[order]
    head = np.r_[True, key[1:] != key[:-1]]
    more = ~head
    more[:-1] |= ~head[1:]
    more |= mark
    return key[more], cls[more]


_MAP = "bucket int, kind int, id {id}, th long, class long, n long, data binary, members binary"


def _map(n_buckets: int, shingle: int, least: Least):
    """Rows of kind 0: a document (data: its class's bitmap); 1: packed tiles of a bucket; 2: packed (tile, class) of groups met here."""

    def schema_of(id_type) -> pa.Schema:
        return pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("id", id_type), ("th", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("members", pa.binary())])

    def wide(rows: pa.RecordBatch, id_type) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3, rows.column(2), rows.column(3)], schema=schema_of(id_type))

    def run(batches):
        names, classes, held = [], [], 0
        done: set[int] = set()
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for c in tokens.chunks(b.column(1)):
                sets = tokens.shingle_sets(tokens.words(c), shingle)
                ids = [tokens.set_id(s) if len(s) else None for s in sets]
                maps = []
                for s, i in zip(sets, ids, strict=True):
                    if i is None or i in done:
                        maps.append(None)
                        continue
                    done.add(i)
                    maps.append(bitmap(s))
                    t = tiles(s, least)
                    if len(t):
                        names.append(t), classes.append(i)
                        held += len(t)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(c.first, c.first + n) % n_buckets, pa.int32()), pa.array(np.zeros(n, np.int32)), b.column(0).slice(c.first, n), b.column(2).slice(c.first, n),
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.binary()),
                ], schema=schema_of(id_type))
                if held >= FLUSH:
                    yield wide(packed(names, classes, n_buckets), id_type)
                    names, classes, held = [], [], 0
                if held == 0 or len(done) > KNOWN:
                    done.clear()  # bounded; a class seen again is merged later
        if names:
            yield wide(packed(names, classes, n_buckets), id_type)

    return run


_REDUCED = "kind int, id {id}, th long, class long, n long, bits binary, tile long"


def _reduce():
    def schema_of(id_type) -> pa.Schema:
        return pa.schema([("kind", pa.int32()), ("id", id_type), ("th", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("tile", pa.int64())])

    def groups(key: np.ndarray, cls: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, 1, np.int32)), pa.nulls(n, schema.field("id").type), pa.nulls(n, pa.int64()), pa.array(cls),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(key.view(np.int64)),
        ], schema=schema)

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, schema = [], None
        for b in group:
            schema = schema or schema_of(b.column("id").type)
            kind = b.column("kind").to_numpy()
            docs = b.filter(pa.array(kind == 0))
            if docs.num_rows:
                known = [docs.column(c) for c in ("kind", "id", "th", "class", "n", "data")]
                yield pa.RecordBatch.from_arrays([*known, pa.nulls(docs.num_rows, pa.int64())], schema=schema)
            for i in np.flatnonzero(kind):
                part = unpacked(b.column("bucket")[i].as_py(), kind[i], b.column("data")[i].as_buffer(), b.column("members")[i].as_buffer())
                if kind[i] == 2:
                    yield groups(*part[:2], schema)
                else:
                    parts.append(part)
        if not parts:
            return
        key, cls = in_groups(parts)
        for i in range(0, len(key), 1 << 16):
            yield groups(key[i : i + (1 << 16)], cls[i : i + (1 << 16)], schema)

    return run


# ---- candidate pairs ------------------------------------------------------------------------------


def _as_words(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Bitmaps of mixed widths: each row's width in words, its place among those, and a matrix for each width."""
    width = np.array([len(x) // 8 for x in bits], np.int64)
    place, by = np.zeros(len(bits), np.int64), {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        place[rows] = np.arange(len(rows))
        by[w] = np.frombuffer(b"".join([bits[i] for i in rows]), U64).reshape(-1, w)
    return width, place, by


def differing(left, i: np.ndarray, right, j: np.ndarray) -> np.ndarray:
    """In how many bits row i[k] of left and row j[k] of right differ, at the smaller width of the two."""
    (lw, lp, lby), (rw, rp, rby) = left, right
    out = np.zeros(len(i), np.int64)
    code = lw[i] * 1024 + rw[j]
    for c in np.unique(code).tolist():
        every = np.flatnonzero(code == c)
        words = min(divmod(c, 1024))
        step = max(1, (1 << 18) // max(divmod(c, 1024)))  # 2 MB of bitmaps on each side
        for k in range(0, len(every), step):
            at = every[k : k + step]
            a, b = folded(lby[c // 1024][lp[i[at]]], words), folded(rby[c % 1024][rp[j[at]]], words)
            out[at] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


def _screen(least: Least):
    """(a, b, na, nb, bits of both) -> (a, b, may)."""

    def run(batches):
        for t in batches:
            n = t.num_rows
            at = np.arange(n)
            na, nb = t.column(2).to_numpy(), t.column(3).to_numpy()
            may = np.zeros(n, bool)
            if n:
                may = may_link(na, nb, differing(_as_words(t.column(4).to_pylist()), at, _as_words(t.column(5).to_pylist()), at), least)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(may)], names=["a", "b", "may"])

    return run


def screened(pairs: DataFrame, sized: DataFrame, least: Least) -> DataFrame:
    """Pairs (a, b) of classes with ``may``: whether their sizes and bitmaps allow a link."""
    both = pairs.join(sized.toDF("a", "na", "bits_a"), "a").join(sized.toDF("b", "nb", "bits_b"), "b")
    return _screened(both, least)


def _screened(both: DataFrame, least: Least) -> DataFrame:
    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(freeing(_screen(least)), "a long, b long, may boolean")


def _pairs_in(start: np.ndarray, size: np.ndarray, side: np.ndarray, diagonal: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each block; off the diagonal only those between its two sides."""
    for g in np.unique(size[diagonal]).tolist():
        if g < 2:
            continue
        x, y = np.triu_indices(g, 1)
        at = start[diagonal & (size == g)]
        step = max(1, most // len(x))
        for k in range(0, len(at), step):
            base = at[k : k + step, None]
            yield (base + x).ravel(), (base + y).ravel()
    for s, n in zip(start[~diagonal].tolist(), size[~diagonal].tolist(), strict=True):
        one = int(np.count_nonzero(side[s : s + n] == side[s]))
        yield np.repeat(np.arange(s, s + one), n - one), np.tile(np.arange(s + one, s + n), one)


def _compare(least: Least):
    """Blocks, sorted by (tile, lo, hi, side): (tile, lo, hi, side, class, comp, n, bits) -> (a, b) that may link."""

    def run(batches):
        def blocks(t: pa.Table):
            key = [t.column(k).to_numpy() for k in range(4)]
            cls, comp, n = (t.column(k).to_numpy() for k in (4, 5, 6))
            head = np.ones(t.num_rows, bool)
            head[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            start = np.flatnonzero(head)
            size = np.diff(np.r_[start, t.num_rows])
            bits = _as_words(t.column(7).to_pylist())
            for i, j in _pairs_in(start, size, key[3], key[1][start] == key[2][start]):
                ok = (comp[i] != comp[j]) & (least[1] * np.minimum(n[i], n[j]) >= least[0] * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                ok = may_link(n[i], n[j], differing(bits, i, bits, j), least) if len(i) else np.zeros(0, bool)
                if ok.any():
                    a, b = cls[i[ok]], cls[j[ok]]
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            key = [rest.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last block may go on in the next batch
            if cut:
                yield from blocks(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)
        if rest is not None:
            yield from blocks(rest.combine_chunks())

    return run


def _sets(shingle: int):
    def run(batches):
        done: set[int] = set()
        for b in batches:
            for c in tokens.chunks(b.column(0)):
                names, sets = [], []
                for s in tokens.shingle_sets(tokens.words(c), shingle):
                    if len(s) and (i := tokens.set_id(s)) not in done:
                        done.add(i)
                        names.append(i), sets.append(s.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["class", "set"])
                if len(done) > KNOWN:
                    done.clear()

    return run


def _exact(least: Least):
    """(a, b, set of a, set of b) -> (a, b) that link."""

    def run(batches):
        for t in batches:
            ok = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                x, y = (np.frombuffer(t.column(c)[k].as_buffer(), U64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                ok[k] = links(len(x), len(y), int(np.count_nonzero(y[at] == x)), least)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _sets_of(pairs: DataFrame, info: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(class, set), once for each class in pairs (a, b); a text of each is read again."""
    classes = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = materialise(classes.join(info.select("class", "th"), "class").select("th").distinct())
    few = needed.count() <= 1_000_000  # 8 MB; more are joined by a shuffle
    mine = texts.join(F.broadcast(needed) if few else needed, "th", "left_semi").select("text")
    return mine.mapInArrow(freeing(_sets(shingle)), "class long, set binary").dropDuplicates(["class"])


def _side_by_side(pairs: DataFrame, info: DataFrame, texts: DataFrame, shingle: int, *more: str) -> list[DataFrame]:
    """Pairs (a, b) as (a, b, set_a, set_b), with their columns ``more``: those of ordinary classes b, and those of centres with many pairs."""
    hot = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts")).where("parts > 1"))
    n_hot = hot.count()
    if n_hot <= 200_000:  # a few megabytes
        hot = F.broadcast(hot)
    sets = _sets_of(pairs, info, texts, shingle)
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    columns = ["a", "b", "set_a", "set_b", *more]
    out = [(pairs.join(hot, "b", "left_anti") if n_hot else pairs).join(left, "a").join(right, "b").select(*columns)]
    if n_hot:  # a centre's set goes out once for each SALT of its pairs
        dealt = pairs.join(hot, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
        right = right.join(hot, "b").select("b", "set_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        out.append(dealt.join(left, "a").join(right, ["b", "salt"]).select(*columns))
    return out


def _verified(pairs: DataFrame, info: DataFrame, texts: DataFrame, shingle: int, least: Least) -> DataFrame:
    """The pairs (a, b) of classes that link, by their shingle sets."""
    return reduce(DataFrame.unionByName, [p.mapInArrow(freeing(_exact(least)), "a long, b long") for p in _side_by_side(pairs, info, texts, shingle)])


def prefix(s: np.ndarray, centre: np.ndarray, least: Least) -> np.ndarray:
    """The first n - ceil(least * n) + 1 shingles of s in the order: those not in centre, then those in it, each by hash."""
    at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
    inside = centre[at] == s
    return np.concatenate([s[~inside], s[inside]])[: len(s) - -(-least[0] * len(s) // least[1]) + 1]


#: Bits of the fixed bitmap of prefixes (8 MB); beyond its capacity it lets more through, never less.
BITS = 1 << 26


def _places(names: np.ndarray) -> np.ndarray:
    return (tokens.mix(names) & U64(BITS - 1)).astype(np.int64)


def _pieces(batches):
    """Packed names -> pieces of a bitmap of them, once for each task: (k, 4 KB)."""
    pieces: dict[int, np.ndarray] = {}
    for b in batches:
        for bucket, kind, data, members in zip(*(b.column(k) for k in range(4)), strict=True):
            at = np.unique(_places(unpacked(bucket.as_py(), kind.as_py(), data.as_buffer(), members.as_buffer())[0]))
            k = at >> 15
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            for x, y in zip(cuts, np.r_[cuts[1:], len(k)], strict=True):
                piece = pieces.setdefault(int(k[x]), np.zeros(4096, np.uint8))
                np.bitwise_or.at(piece, (at[x:y] & 32767) >> 3, (1 << (at[x:y] & 7)).astype(np.uint8))
    names = list(pieces)
    for i in range(0, len(names), 256):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 256], pa.int32()), pa.array([pieces[k].tobytes() for k in names[i : i + 256]], pa.binary())], names=["k", "bits"])


def _bitmap_of(names: DataFrame) -> np.ndarray:
    """A bitmap of packed names, put together by Spark in pieces of 4 KB; its size is that of BITS, whatever the table's."""
    out = np.zeros(BITS // 8, np.uint8)
    for r in names.mapInArrow(freeing(_pieces), "k int, bits binary").groupBy("k").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _prefixes(least: Least):
    """(a, b, set of a, set of b, home) -> (a, home, names): a name for each shingle of a's prefix, apart for each b."""

    def run(batches):
        for t in batches:
            centre, names = t.column(1).to_numpy(), []
            for k in range(t.num_rows):
                x, y = (np.frombuffer(t.column(c)[k].as_buffer(), U64) for c in (2, 3))
                names.append(tokens.mix(prefix(x, y, least) ^ tokens.mix(centre[k : k + 1].view(U64))).tobytes())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(4), pa.array(names, pa.binary())], names=["a", "home", "names"])

    return run


def _dealt(n_buckets: int, seen=None):
    """(a, home, names) -> packed (name, a); seen: a bitmap of the names that count."""

    def run(batches):
        names, classes, held = [], [], 0
        for t in batches:
            for a, raw in zip(t.column(0).to_pylist(), t.column(2), strict=True):
                name = np.frombuffer(raw.as_buffer(), U64)
                if seen is not None:
                    at = _places(shortened(name, n_buckets))
                    name = name[(seen.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                names.append(name), classes.append(a)
                held += len(name)
                if held >= FLUSH:
                    yield packed(names, classes, n_buckets)
                    names, classes, held = [], [], 0
        if held:
            yield packed(names, classes, n_buckets)

    return run


def _meet(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed names of a bucket -> (tile, class) of those that several classes have."""
    parts = []
    for b in group:
        for bucket, kind, data, members in zip(*(b.column(k) for k in ("bucket", "kind", "data", "members")), strict=True):
            part = unpacked(bucket.as_py(), kind.as_py(), data.as_buffer(), members.as_buffer())
            if kind.as_py() == 2:
                yield pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["tile", "class"])
            else:
                parts.append(part)
    if parts:
        key, cls = in_groups(parts)
        for i in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(cls[i : i + (1 << 16)])], names=["tile", "class"])


def across(groups: DataFrame, again: DataFrame, least: Least) -> DataFrame:
    """(a, b): pairs of members of one tile in different components whose sizes and bitmaps allow a link."""
    met = groups.join(again.select("class", "comp"), "class")
    mixed = met.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(mixed, "tile").join(again, "class").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tile", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "class", "comp", "n", "bits")
    dealt = dealt.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi", "side")
    return dealt.mapInArrow(freeing(_compare(least)), "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: Least) -> tuple[DataFrame, DataFrame]:
    """(id, th, class, n) of each row, class null without shingles; and (class, id, comp) of each class, id the smallest of its rows."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("th"))
    packed = texts.mapInArrow(freeing(_map(buckets(spark), shingle, least)), _MAP.format(id=id_type))
    every = materialise(packed.groupBy("bucket").applyInArrow(_reduce(), _REDUCED.format(id=id_type)))

    rows = every.where("kind = 0").select("id", "th", "class", "n")
    info = every.where("kind = 0 and class is not null").groupBy("class").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("th").alias("th"), F.min("id").alias("id"))
    info = materialise(info)
    groups = every.where("kind = 1").select("tile", "class").distinct()
    groups = materialise(groups)

    return rows, connect(groups, info, texts, shingle, least)


def connect(groups: DataFrame, info: DataFrame, texts: DataFrame, shingle: int, least: Least, neighbours: DataFrame | None = None, deeper: DataFrame | None = None) -> DataFrame:
    """(class, id, comp): the components of the links between classes that share a tile of groups (tile, class).

    Pairs of neighbours (a, b) and of members of small deeper groups (tile, class), parts of those groups, are
    compared too where the stars leave them apart.
    """
    spark = groups.sparkSession
    # every member with its tile's most connected class
    sizes = groups.groupBy("tile").agg(F.count("*").alias("size"))
    reach = groups.join(sizes, "tile").groupBy("class").agg(F.sum("size").alias("reach"))
    first = materialise(groups.join(reach, "class").groupBy("tile").agg(F.max_by("class", F.struct("reach", "class")).alias("b")))
    stars = groups.join(first, "tile").where("class <> b").select(F.col("class").alias("a"), "b").distinct()
    sized = info.select("class", "n", "bits")
    stars = materialise(screened(stars, sized, least))
    found = materialise(_verified(stars.where("may").select("a", "b"), info, texts, shingle, least))
    comps = materialise(components(found))

    # components that meet in an unlinked pair: compare across them wherever they share a tile
    of = comps.select(F.col("node").alias("class"), F.col("component").alias("comp"))
    apart = stars.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    open_ = apart.select(F.explode(F.array("ca", "cb")).alias("comp")).distinct()
    again = sized.join(of, "class", "left").withColumn("comp", F.coalesce("comp", "class")).join(open_, "comp", "left_semi")
    again = materialise(again.select("class", "comp", "n", "bits"))
    met = groups.join(again.select("class", "comp"), "class")
    mixed = materialise(met.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("tile", "size"))
    crowded = mixed.where(F.col("size") > CROWD)
    small = groups.join(mixed.where(F.col("size") <= CROWD), "tile", "left_semi")
    met_again = small if deeper is None else small.unionByName(deeper)
    if crowded.limit(1).count():
        led = crowded.join(first, "tile").join(of.toDF("b", "cb"), "b", "left").select("tile", "b", F.coalesce("cb", "b").alias("cb"))
        centres = led.groupBy("cb", "b").agg(F.count("*").alias("k")).groupBy("cb").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        held = met.join(led.select("tile", "cb").join(centres, "cb"), "tile").select(F.col("class").alias("a"), "b", (F.col("comp") == F.col("cb")).alias("home")).distinct()
        held = materialise(held)
        n_buckets = buckets(spark)

        parts = _side_by_side(held, info, texts, shingle, "home")
        prefixes = materialise(reduce(DataFrame.unionByName, [p.mapInArrow(freeing(_prefixes(least)), "a long, home boolean, names binary") for p in parts]))
        strangers = materialise(prefixes.where("not home").mapInArrow(freeing(_dealt(n_buckets)), _PACKED))
        seen = spark.sparkContext.broadcast(_bitmap_of(strangers))
        family = prefixes.where("home").mapInArrow(freeing(_dealt(n_buckets, seen)), _PACKED)
        meeting = strangers.unionByName(family).groupBy("bucket").applyInArrow(_meet, "tile long, class long").distinct()
        met_again = met_again.unionByName(materialise(meeting))
    near = across(met_again, again, least)
    if neighbours is not None:
        side = lambda x: again.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"), F.col("comp").alias(f"c{x}"))
        apart = neighbours.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
        near = near.unionByName(_screened(apart, least).where("may").select("a", "b"))
    more = _verified(materialise(near.distinct()), info, texts, shingle, least)
    # these links join components, whose names are their smallest classes
    more = more.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = materialise(components(more)).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
    named = info.select("class", "id").join(of, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    return named.join(joined, "comp", "left").select("class", "id", F.coalesce("whole", "comp").alias("comp"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Least = (NUM, DEN)) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; two link from the similarity `least`, below 1, of their sets of `shingle` words on."""
    rows, classes = _classes(docs, id_col, text_col, shingle, least)
    smallest = classes.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = classes.select("class", "comp").join(smallest, "comp").select("class", "component_id")
    out = rows.join(named, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


@shielded
def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Least = (NUM, DEN)) -> DataFrame:
    """The rows of docs, with all their columns, less those linked with one that stays.

    Of each component the row with the smallest id stays (null ids last, ties by the text's hash); of rows alike in
    id and text one.  Rows with different texts that merely share an id are apart.  Rows without shingles all stay.
    """
    rows, classes = _classes(docs, id_col, text_col, shingle, least)
    rows = rows.where("class is not null").groupBy("class", "id", "th").agg(F.count("*").alias("alike"))
    who = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("alike").alias("alike"))
    best = rows.join(classes.select("class", "comp"), "class").groupBy("comp").agg(F.min(who).alias("w"))
    best = materialise(best.select(F.col("w.id").alias("__id"), F.col("w.th").alias("__th"), F.col("w.alike").alias("alike")))
    docs = without(docs, [])
    fits = (text_hash(text_col) == F.col("__th")) & F.col(id_col).eqNullSafe(F.col("__id"))
    silent = ~F.coalesce(F.col(text_col).cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    once = best.where("alike = 1")
    if once.count() <= 500_000:  # a dozen megabytes; more are joined by a shuffle of the rows
        once = F.broadcast(once)
    kept = docs.where(~silent).join(once, fits, "left_semi").unionByName(docs.where(silent))
    repeated = best.where("alike > 1")
    if repeated.limit(1).count():
        kept = kept.unionByName(docs.where(~silent).join(repeated, fits, "left_semi").dropDuplicates([id_col, text_col]))
    return kept
