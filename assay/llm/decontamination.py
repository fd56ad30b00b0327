"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is contained in a document if at least ``least`` (0.8) of its
distinct five-word shingles occur in the document, whatever the document's
length.  Items are partitioned by size (powers of two).  All items of a
partition are sketched with the same number k of smallest shingle hashes
(bottom-k MinHash), k being what the largest size of the partition needs so
that ANY document that contains an item holds at least one hash of its sketch:
k > size - ceil(least * size).  The search therefore misses nothing.  A document
probes the sketches of all partitions with its shingles; items it meets are
verified by exact shingle containment in the same task.  Documents are read once
and never shuffled; a document of any length is one row of work.

The index holds items, not documents.  It is broadcast only up to about
``block_shingles`` shingles; a larger benchmark is dealt into blocks by a hash of
the items, and each block is fetched, broadcast, searched with one pass over the
documents, its hits written out, and released before the next, so the driver never
holds more than one.

Words: A-Z lower-cased runs of non-blank bytes.  An item with one to four words
has its word sequence as its only shingle and so matches documents with exactly
these words.  Null and empty texts contain and are contained in nothing.
Repeated documents or items are each reported; ids may have any type.  Very long
texts are one row each in Arrow batches bounded in bytes.  Empty tables give an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import tokens
from assay.llm.common import freeing, materialise, small_batches, text_udf, without

SHINGLE, LEAST = 5, 0.8


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * n - 1e-9).astype(np.int64)


class Index:
    """Sketches and shingles of a block of items."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.maximum(1, _needed(self.size, least))
        sketch, owner = [], []
        for i, s in enumerate(sets):
            band = 1 << int(len(s)).bit_length()  # sizes of this partition are below
            k = min(len(s), band - int(_needed(np.array([band]), least)[0]) + 1)
            sketch.append(s[:k])
            owner.append(np.full(k, i))
        h, o = np.concatenate([np.zeros(0, tokens.U64), *sketch]), np.concatenate([np.zeros(0, np.int64), *owner])
        by = np.argsort(h, kind="stable")
        self.hash, self.owner = h[by], o[by]
        self.sets = sets
        self.seen = np.zeros(1 << 20, bool)  # a first look at 20 bits of the hash
        self.seen[(self.hash >> tokens.U64(44)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item's number, shared shingles) of the items contained in a document with these distinct, ascending shingles."""
        near = shingles[self.seen[(shingles >> tokens.U64(44)).astype(np.int64)]]
        if not len(near) or not len(self.hash):
            return []
        a, b = np.searchsorted(self.hash, near, "left"), np.searchsorted(self.hash, near, "right")
        found = sorted({int(i) for x, y in zip(a, b, strict=True) for i in self.owner[x:y]})
        out = []
        for i in found:
            at = np.searchsorted(shingles, self.sets[i])
            shared = int(np.count_nonzero(shingles[np.minimum(at, len(shingles) - 1)] == self.sets[i]))
            if shared >= self.need[i]:
                out.append((i, shared))
        return out


def _sets(column) -> Iterator[np.ndarray]:
    for c in tokens.chunks(column):
        yield from tokens.shingle_sets(tokens.words(c), SHINGLE)


def _item_rows(batches):
    for b in batches:
        sets = list(_sets(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["item", "shingles", "n"])


def _searcher(index):
    """(id, text) -> (id, number of the item in its block, shingles of the item, shared ones)."""

    def run(batches):
        for b in batches:
            row, item, n, shared = [], [], [], []
            for i, s in enumerate(_sets(b.column(1))):
                for j, k in index.value.hits(s):
                    row.append(i), item.append(j), n.append(int(index.value.size[j])), shared.append(k)
            found = [b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["id", "number", "n_item", "n_shared"])

    return run


def _counter(index):
    return text_udf("long", lambda text: pa.array([len(index.value.hits(s)) for s in _sets(text)], pa.int64()))


def _blocks(items: DataFrame, block_shingles: int, least: float):
    """An index of each block of items (item, text) with the ids of its items, one at a time; at least one."""
    item_type = items.schema["item"].dataType.simpleString()
    sized = materialise(items.mapInArrow(freeing(_item_rows), f"item {item_type}, shingles binary, n long").where("n > 0"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    n_blocks = max(1, -(-total // block_shingles))
    for k in range(n_blocks):
        rows = sized.where(F.pmod(F.xxhash64("shingles"), F.lit(n_blocks)) == k).select("item", "shingles").collect()
        yield Index([np.frombuffer(bytes(r.shingles), tokens.U64) for r in rows], least), [r.item for r in rows], n_blocks


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least: float = LEAST, block_shingles: int = 2_000_000,
) -> DataFrame:
    """(id, item, n_item, n_shared, containment) for each document and item contained in it."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts, result = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), None
    for index, ids, n_blocks in _blocks(items, block_shingles, least):
        shared = spark.sparkContext.broadcast(index)
        names = spark.createDataFrame(list(enumerate(ids)), items.select(F.lit(0).cast("long").alias("number"), "item").schema)
        part = texts.mapInArrow(freeing(_searcher(shared)), f"id {id_type}, number long, n_item long, n_shared long").join(F.broadcast(names), "number")
        part = part.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
        if n_blocks > 1:
            part = materialise(part)
            shared.destroy()
        result = part if result is None else result.unionByName(part)
    return result


def with_item_counts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, block_shingles: int = 2_000_000) -> DataFrame:
    """docs with ``n_items``, the number of items that each row contains (0: clean); an input column of that name is replaced.

    Only the text travels to Python; the other columns stay in the JVM.  With several blocks the rows are numbered and
    written once, whatever the number of blocks; a block writes the numbers and counts of the rows that it hits, and these
    are summed and joined back at the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    docs = without(docs, ["n_items"])
    row = "row" + "_" * max(len(c) for c in docs.columns)  # longer than any name of docs
    numbered = hits = None
    for index, _, n_blocks in _blocks(items, block_shingles, least):
        shared = spark.sparkContext.broadcast(index)
        n = _counter(shared)(F.col(text_col).cast("string"))
        if n_blocks == 1:
            return docs.withColumn("n_items", n)
        if numbered is None:
            numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
        part = materialise(numbered.select(row, n.alias("n_items")).where("n_items > 0"))
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    found = numbered.join(hits.groupBy(row).agg(F.sum("n_items").alias("n_items")), row, "left").drop(row)
    return found.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
