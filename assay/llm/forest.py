"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, depth by region.

Documents are sets of distinct three-word shingles; two link when
100 * |A & B| >= 85 * |A | B| (both are arguments).  Equal sets are one *class*.

Trees.  A class has a MinHash signature for each of TREES trees: DEPTH values of 32
bits, each the smallest of its shingles' hashes under another hash function.  The
signatures of a tree, sorted as byte strings, are the tree: what has a longer common
prefix stands closer together.  Spark sorts all trees at once by (tree, signature,
class) with one range exchange, which cuts a crowded place wherever it likes.

Regions.  Rows whose first LEAST_DEPTH values agree are a region.  Two texts of
similarity s share one in at least one tree with probability 1 - (1 - s^4)^16:
0.999993 at 0.85, more above.  The depth follows the data: a region of more than
``ngram_join.CROWD`` rows is descended, value by value, until each part is small
enough or the signature ends.

Candidates.  First each member of a region with the region's most connected class:
verified links make components, so a group of copies costs a pair for each member.
Then whatever is still apart: longest-common-prefix neighbours (rows that stand next
to each other in a tree), all pairs across components of a descended region, and all
those of a region that was not crowded.  The members of a crowded region also meet by
the prefix principle (see ngram_join.connect), which is exact: what descending parted
is found whatever the region's size.  Every pair is screened by sizes and parity
bitmaps and confirmed on the full sets.

Result: (id, n_shingles, component_id, kept), a row for each input row; component_id is
the smallest id reachable by links, kept says whether it is the row's own.  Null and
empty texts have no shingles and link with nothing.  A null id takes part in links,
gets its component's smallest non-null id, or null, and is kept only if it has none.
Repeated rows are one class and share id and verdict.  Ids may have any type that Spark
can order; a text of any length is one row of work in Arrow batches bounded in bytes;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm import ngram_join, tokens
from assay.llm.common import freeing, materialise, small_batches
from assay.llm.ngram_join import KNOWN, NUM, DEN, Least, bitmap, text_hash
from assay.llm.tokens import U64

SHINGLE = 3
#: Trees, values of a signature, and values that a region shares at least.
TREES, DEPTH, LEAST_DEPTH = 16, 8, 4

_KEYS = tokens.mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _KEYS[: TREES * DEPTH, None], _KEYS[TREES * DEPTH :, None] | U64(1)


def signature(s: np.ndarray, step: int = 1024) -> np.ndarray:
    """TREES rows of DEPTH values of 32 bits: the least of the set's hashes under each function."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(s), step):
        np.minimum(least, ((s[None, k : k + step] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32).reshape(TREES, DEPTH)


_MAP = "kind int, id {id}, th long, class long, n long, bits binary, tree int, signature binary"


def _map(shingle: int):
    """(id, text, th) -> rows of kind 0: a document; 1: a class's place in a tree."""

    def run(batches):
        done: set[int] = set()
        for b in batches:
            schema = pa.schema([("kind", pa.int32()), ("id", b.column(0).type), ("th", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("tree", pa.int32()), ("signature", pa.binary())])
            for c in tokens.chunks(b.column(1)):
                sets = tokens.shingle_sets(tokens.words(c), shingle)
                ids = [tokens.set_id(s) if len(s) else None for s in sets]
                new = {}
                for s, i in zip(sets, ids, strict=True):
                    if i is not None and i not in done:
                        done.add(i)
                        new[i] = s
                n, shown = len(sets), set()
                maps = [None if i not in new or i in shown or shown.add(i) else bitmap(new[i]) for i in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, np.int32)), b.column(0).slice(c.first, n), b.column(2).slice(c.first, n), pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ], schema=schema)
                m = len(new) * TREES
                places = [row.tobytes() for s in new.values() for row in signature(s).astype(">u4")]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(m, np.int32)), pa.nulls(m, schema.field("id").type), pa.nulls(m, pa.int64()), pa.array(np.repeat(np.array(list(new), np.int64), TREES)),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(new))), pa.array(places, pa.binary()),
                ], schema=schema)
                if len(done) > KNOWN:
                    done.clear()  # bounded; a class seen again is merged later

    return run


def common_prefix(tree: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many values each row shares with the row before; 0 for the first one and between trees."""
    if not len(tree):
        return np.zeros(0, np.int64)
    same = np.cumprod(value[1:] == value[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
    return np.r_[0, same].astype(np.int64)


def runs(shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the run of rows that share so many values, for each row."""
    return np.cumsum(shared < depth)


def depths(shared: np.ndarray, crowd: int) -> np.ndarray:
    """For each row the depth at which its region has at most ``crowd`` rows, or DEPTH."""
    out = np.full(len(shared), LEAST_DEPTH)
    for depth in range(LEAST_DEPTH, DEPTH):
        run = runs(shared, depth)
        out[(out == depth) & (np.bincount(run)[run] > crowd)] = depth + 1
    return out


def names(tree: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit name of each row's first ``depth`` values."""
    h = tree.astype(U64) * U64(DEPTH + 1) + U64(depth)
    for k in range(depth):
        h = tokens.mix(h * U64(0x9E3779B97F4A7C15) + value[:, k].astype(U64))
    return h


_TREE = "kind int, a long, b long, tree int, signature binary"


def _forest(crowd: int):
    """Sorted (tree, signature, class) -> rows of kind 0: neighbours (a, b); 1: (region a, class b); 2: (descended region a, class b); 3: an end of a partition, class b."""

    def regions(tree: np.ndarray, value: np.ndarray, cls: np.ndarray, ends: bool) -> Iterator[pa.RecordBatch]:
        shared = common_prefix(tree, value)
        near = shared >= LEAST_DEPTH
        at = np.flatnonzero(near)
        yield row(0, cls[at - 1], cls[at])
        company = near | np.r_[near[1:], ends]
        if ends:  # its region may go on in another partition
            company |= (runs(shared, LEAST_DEPTH) == 1)
        yield row(1, names(tree, value, LEAST_DEPTH)[company].view(np.int64), cls[company])
        depth = depths(shared, crowd)
        for d in range(LEAST_DEPTH + 1, DEPTH + 1):
            mine = depth == d
            if mine.any():
                run = runs(shared, d)
                mine &= np.bincount(run)[run] > 1
                yield row(2, names(tree, value, d)[mine].view(np.int64), cls[mine])

    def row(kind: int, a: np.ndarray, b: np.ndarray, tree=None, value=None) -> pa.RecordBatch:
        n = len(a)
        rest = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())] if tree is None else [pa.array(tree, pa.int32()), pa.array([v.astype(">u4").tobytes() for v in value], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), *rest], names=["kind", "a", "b", "tree", "signature"])

    def run(batches):
        rest, first = None, True
        tree = value = cls = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, cls = b.column("tree").to_numpy(), b.column("class").to_numpy()
            value = np.frombuffer(b"".join(b.column("signature").to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
            if first:
                yield row(3, cls[:1], cls[:1], tree[:1], value[:1])
            if rest is not None:
                tree, value, cls = (np.concatenate(x) for x in zip(rest, (tree, value, cls), strict=True))
            new = np.r_[True, (cls[1:] != cls[:-1]) | (tree[1:] != tree[:-1])]  # a class may come from several tasks
            tree, value, cls = tree[new], value[new], cls[new]
            # whole regions; one that fills batch after batch is passed on in parts that overlap by a row
            heads = np.flatnonzero(common_prefix(tree, value) < LEAST_DEPTH)
            cut = int(heads[-1])
            if cut == 0 and len(cls) > MOST:
                yield from regions(tree, value, cls, True)
                cut, first = len(cls) - 1, False
            elif cut:
                yield from regions(tree[:cut], value[:cut], cls[:cut], first)
                first = False
            rest = tree[cut:], value[cut:], cls[cut:]
        if rest is not None:
            yield from regions(*rest, True)
            yield row(3, cls[-1:], cls[-1:], tree[-1:], value[-1:])

    return run


#: Rows of a region that a task holds at once.
MOST = 1 << 18


def sorted_trees(places: DataFrame) -> DataFrame:
    """Neighbours, regions and descended regions of (tree, signature, class): see _forest; neighbours across partitions are among them."""
    order = ["tree", "signature", "class"]
    every = materialise(places.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freeing(_forest(ngram_join.CROWD)), _TREE))
    ends = every.where("kind = 3").select("tree", "signature", "b")  # two rows a partition
    before = Window.orderBy("tree", "signature", "b")
    over = ends.select("b", "tree", "signature", *[F.lag(c).over(before).alias(f"{c}_") for c in ("b", "tree", "signature")])
    start = lambda c: F.substring(c, 1, 4 * LEAST_DEPTH)
    over = over.where((F.col("tree") == F.col("tree_")) & (start("signature") == start("signature_")) & (F.col("b") != F.col("b_")))
    return every.where("kind < 3").select("kind", "a", "b").unionByName(over.select(F.lit(0).alias("kind"), F.col("b_").alias("a"), "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Least = (NUM, DEN)) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; two link from the similarity `least`, below 1, of their sets of `shingle` words on."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("th"))
    every = materialise(texts.mapInArrow(freeing(_map(shingle)), _MAP.format(id=id_type)))
    rows = every.where("kind = 0").select("id", "th", "class", "n")
    info = every.where("kind = 0 and class is not null").groupBy("class").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("th").alias("th"), F.min("id").alias("id"))
    info = materialise(info)
    forest = materialise(sorted_trees(every.where("kind = 1")))
    groups = forest.where("kind = 1").select(F.col("a").alias("tile"), F.col("b").alias("class")).distinct()
    groups = materialise(groups)
    near = forest.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    deep = forest.where("kind = 2").select(F.col("a").alias("tile"), F.col("b").alias("class")).distinct()
    small = deep.groupBy("tile").agg(F.count("*").alias("size")).where(F.col("size").between(2, ngram_join.CROWD))
    classes = ngram_join.connect(groups, info, texts, shingle, least, near, deep.join(small, "tile", "left_semi"))
    smallest = classes.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = classes.select("class", "comp").join(smallest, "comp").select("class", "component_id")
    out = rows.join(named, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
