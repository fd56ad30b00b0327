"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit, then one exchange.

Only DataFrame functions.  A row's sort key is 64 bits: the upper 40 from its
text's hash, the lower 24 from its id's.  Equal texts are therefore neighbours,
yet a splitter can fall between two of them, so that a hot group of copies is
spread over as many shards as its bytes ask for.

1. (key, bytes) of all rows go to a scratch table, once.
2. Bytes and rows are counted below the edges of a grid over the keys.  Cells
   that hold a splitter's target and are still too coarse are divided again and
   only their rows recounted, until each splitter is within its tolerance or next
   to a single row.  The driver sees counts of cells, at most 2^18 in the first
   pass and 64 for each open splitter in the later ones, whatever the number of rows.
3. A broadcast table of the grid's cells (at most 2^18 rows, a dozen megabytes)
   tells each row its bucket; one exchange by bucket, and a row number inside each
   bucket gives the slot, as rows below each bucket are known from the counts.

The number of buckets follows the data: about BUCKET_BYTES each, two or more for
each shuffle partition, MOST_BUCKETS at most.  A shard has several buckets, so no
task holds a whole shard.  Law ``bytes``: shards hold near equal bytes (to
``tolerance`` of a shard or the size of one row, whichever is more).

Rows alike in id and text share a key, and no splitter falls between them.  Where
a splitter misses its tolerance for that reason (one hot key), the rows are written
once with a random salt each, the salt takes part in the lower 24 bits, and the
splitters are found again: such rows are interchangeable.

Null texts have no bytes and a null crc; null ids and null texts get a shard
like any other row; ids may have any type.  A very long text is one row, never
split.  An empty table gives an empty result.  Input columns named like an output
column are replaced; all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.common import materialise, shielded, without

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: About the bytes of a bucket, which one task sorts, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 1 << 15
_MORE, _TAIL = 6, (1 << 24) - 1
_FLIP = -(1 << 63)


def _cell(bits: int) -> Column:
    """The leading bits of the key, in key order."""
    return F.shiftrightunsigned(F.col("__key").bitwiseXOR(F.lit(_FLIP)), 64 - bits)


class Cells:
    """Counts of neighbouring cells of one width: bytes and rows below each and in all."""

    def __init__(self, counts: dict[int, tuple[int, int]]):
        self.cell = sorted(counts)
        self.rows = [counts[c][1] for c in self.cell]
        self.bytes_to = list(accumulate(counts[c][0] for c in self.cell))
        self.rows_to = list(accumulate(self.rows))


def splitters(keys: DataFrame, first: dict[int, tuple[int, int]], bits: int, wanted: list[float], slack: list[float]) -> tuple[list[int], list[int], bool]:
    """Keys (0 .. 2**64) below which about wanted[i] of all bytes lie, the rows below each, and whether a hot key made one miss its slack.

    first: bytes and rows of each cell of so many bits; wanted: ascending shares between 0 and 1; slack: by how much of all bytes each may be missed.
    """
    total = sum(b for b, _ in first.values())
    found: dict[int, tuple[int, int]] = {}
    # open targets by the cell that they lie in: their number, bytes and rows below that cell
    todo: dict[int, list[tuple[int, int, int]]] = {0: [(i, 0, 0) for i in range(len(wanted))]}
    cells, before, missed = {0: Cells(first)}, 0, False
    while todo:
        nxt: dict[int, list[tuple[int, int, int]]] = {}
        for parent, open_ in todo.items():
            inside = cells.get(parent) or Cells({})
            for i, below, below_n in open_:
                goal = wanted[i] * total
                k = bisect_left(inside.bytes_to, goal - below)
                if k == len(inside.cell):  # nothing here reaches the target
                    at = ((parent + 1) << (64 - before)) if before else 1 << 64
                    found[i] = (at, below_n + (inside.rows_to[-1] if inside.cell else 0))
                    continue
                c, b, n = inside.cell[k], below + (inside.bytes_to[k - 1] if k else 0), below_n + (inside.rows_to[k - 1] if k else 0)
                ends = [(c << (64 - bits), b, n), ((c + 1) << (64 - bits), below + inside.bytes_to[k], below_n + inside.rows_to[k])]
                edge = min(ends, key=lambda e: abs(e[1] - goal))
                if abs(edge[1] - goal) > slack[i] * total and inside.rows[k] > 1:
                    if bits < 64:
                        nxt.setdefault(c, []).append((i, b, n))
                        continue
                    missed = True
                found[i] = (edge[0], edge[2])
        todo = nxt
        if todo:
            before, bits = bits, min(64, bits + _MORE)
            part = keys.where(_cell(before).isin(list(todo))) if len(todo) <= 1000 else keys
            counts: dict[int, dict[int, tuple[int, int]]] = {c: {} for c in todo}
            for r in _counted(part, bits).where(F.shiftrightunsigned(F.col("c"), bits - before).isin(list(todo))).collect():
                c = r.c % (1 << 64)
                counts[c >> (bits - before)][c] = (r.b, r.n)
            cells = {c: Cells(x) for c, x in counts.items()}
    return [found[i][0] for i in range(len(wanted))], [found[i][1] for i in range(len(wanted))], missed


def _counted(keys: DataFrame, bits: int) -> DataFrame:
    return keys.groupBy(_cell(bits).alias("c")).agg(F.sum("__size").alias("b"), F.count("*").alias("n"))


@shielded
def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    kept = without(docs, OUT)
    text, ident = F.col(text_col), F.col(id_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")

    def keyed(low: Column) -> Column:
        return F.xxhash64(text).bitwiseAND(F.lit(~_TAIL)).bitwiseOR(low.bitwiseAND(F.lit(_TAIL)))

    key = keyed(F.xxhash64(ident))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for salted in (False, True):
        if salted:
            kept = materialise(kept.withColumn("__salt", F.rand(7)))
            key = keyed(F.xxhash64(ident, "__salt"))
        keys = materialise(kept.select(key.alias("__key"), size.alias("__size")))
        total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("b")).head().b
        each = max(1, min(max(-(-2 * partitions // shards), -(-total // (BUCKET_BYTES * shards))), MOST_BUCKETS // shards))
        n = shards * each
        bits = max(12, (8 * n - 1).bit_length())
        first = {r.c: (r.b, r.n) for r in _counted(keys, bits).collect()}
        cut, below, missed = splitters(keys, first, bits, [i / n for i in range(1, n)], [(tolerance if i % each == 0 else 0.1 / each) / shards for i in range(1, n)])
        if not missed:
            break
    below = [0, *sorted(below)]
    offset = [below[i] - below[i - i % each] for i in range(n)]
    edges = sorted(cut)
    low = [bisect_right(edges, c << (64 - bits)) for c in range((1 << bits) + 1)]
    # the keys of a cell: its first bucket, the edges inside, and the offsets of the buckets from the first on
    grid = [(c, low[c], [e + _FLIP for e in edges[low[c] : low[c + 1]] if e < (c + 1) << (64 - bits)], offset[low[c] : low[c + 1] + 1]) for c in range(1 << bits)]
    table = spark.createDataFrame(grid, "__cell long, __low int, __cuts array<long>, __offsets array<long>")

    dealt = kept.withColumns({"__key": key, "size": size, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}).withColumn("__cell", _cell(bits))
    dealt = dealt.join(F.broadcast(table), "__cell").withColumn("__past", F.size(F.filter("__cuts", lambda e: e <= F.col("__key"))))
    dealt = dealt.withColumns({"__bucket": F.col("__low") + F.col("__past"), "__offset": F.element_at("__offsets", F.col("__past") + 1)})
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", ident, "text_crc32", "size")) - 1
    out = dealt.withColumns({
        "law": F.lit("bytes"), "shard": F.floor(F.col("__bucket") / each).cast("int"), "slot": (F.col("__offset") + place).cast("long"), "grown_shard": F.lit(None).cast("int"),
    })
    return out.drop("__key", "__cell", "__low", "__cuts", "__offsets", "__past", "__bucket", "__offset", "__salt")
