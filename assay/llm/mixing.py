"""Mixing sources to target weights: temperature, bisection, block permutations.

Shares p of the sources (by tokens, here words) become weights p^a / sum p^a.
The exponent a is bisected between 0 (uniform) and 1 (as found) until the
mixture meets its target, an entropy of the weights in nats: ``entropy``, or, by
default, the share ``flatten`` of the way from the sources' own entropy to the
uniform one, so that the target lies strictly between the two ends whatever the
table (unless all sources are alike).  ``repetition`` is a limit beside it: where
the flattened mixture would read a source more often than that, the exponent is
bisected to the limit instead.  The budget is the smallest one in which every
source is read at least once, so no row is lost; a source with k.f epochs appears
whole k times and then with the share f of its tokens.

Each source's rows are dealt into blocks of about BLOCK_ROWS by a hash of id and
text; every epoch permutes the blocks of a source and the rows in each block
anew.  A row's place in its source is the length of the blocks before it plus its
place in its own block, so only a block is ever sorted in one task: a source with
a third of all rows has a third of all blocks.  Rows alike in source, id and text
share a hash; where one such group is larger than MOST_ALIKE rows, the table is
written once with a random salt for each row, and the salt is part of the hash.
``mix_key`` (0 to 1) is the part of the source's budget read before the row: in
its order every prefix of the result has about the target weights.

Result: the input rows, each as often as its source's budget asks, with
``weight, epoch, block, position, n_tokens, mix_key`` and, the same in all rows,
``exponent, entropy`` (of the weights) and ``repetition`` (of the source that is
read most often).  Null sources form a source of their own; null and empty texts
count no tokens and come with every epoch that is read whole.  A source without
tokens has weight 0 and is read once.  Repeated rows are rows like any other.
Ties of the order in a block are broken by hash, id, text hash and tokens; rows
alike in all of these are interchangeable.  Very long texts are one row of a block;
only their count of tokens is looked at.  Input columns named like an output
column are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import materialise, shielded, without

OUT = ("weight", "epoch", "block", "position", "n_tokens", "mix_key", "exponent", "entropy", "repetition")
#: Rows in a block, about, and blocks of a source at most (a window sorts their lengths); beyond, blocks grow.
BLOCK_ROWS, MOST_BLOCKS = 256, 1 << 20
#: Rows alike in source, id and text from which on they are salted.
MOST_ALIKE = 1024


def weights(tokens: Sequence[float], a: float) -> list[float]:
    """Tempered shares; sources without tokens get 0."""
    total = float(sum(tokens))
    powers = [(t / total) ** a if t > 0 else 0.0 for t in tokens]
    norm = sum(powers)
    return [x / norm for x in powers] if norm else [0.0 for _ in tokens]


def epochs(tokens: Sequence[float], w: Sequence[float]) -> list[float]:
    """How often each source is read if the one that is read least is read once."""
    ratio = [x / t if t > 0 else 0.0 for x, t in zip(w, tokens, strict=True)]
    least = min((r for r in ratio if r > 0), default=0.0)
    return [r / least if r > 0 else 1.0 for r in ratio]


def spread(w: Sequence[float]) -> float:
    """Entropy in nats."""
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent(tokens: Sequence[float], flatten: float = 0.5, entropy: float | None = None, repetition: float | None = None, rounds: int = 60) -> float:
    """The exponent in [0, 1] whose weights have the target entropy, or the smallest one from there on that keeps the repetition limit.

    Repetition and entropy both fall as the exponent grows, so bisection finds it; a target out of reach gives the nearer end.
    """
    flat, own = weights(tokens, 0.0), weights(tokens, 1.0)
    goal = entropy if entropy is not None else spread(own) + flatten * (spread(flat) - spread(own))

    def too_flat(a: float) -> bool:
        w = weights(tokens, a)
        return spread(w) > goal or repetition is not None and max(epochs(tokens, w), default=1.0) > repetition

    if not too_flat(0.0):
        return 0.0
    if too_flat(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


@shielded
def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", flatten: float = 0.5, entropy: float | None = None,
    repetition: float | None = 2.0, seed: int = 17, most_sources: int = 100_000,
) -> DataFrame:
    """docs in the target mixture.  The table of sources (one row each, at most most_sources) is what the driver sees."""
    kept = without(docs, OUT)
    text = F.col(text_col).cast("string")
    n_tokens = F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    alike = kept.groupBy(F.col(source_col).alias("s"), F.xxhash64(F.col(id_col), text).alias("h")).agg(F.sum(n_tokens).alias("t"), F.count("*").alias("n"))
    found = alike.groupBy("s").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.max("n").alias("most")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them before mixing")
    found.sort(key=lambda r: (r.s is not None, str(r.s)))
    tokens = [r.t for r in found]
    a = exponent(tokens, flatten, entropy, repetition)
    w = weights(tokens, a)
    times = epochs(tokens, w)
    plan = []
    for r, x, e in zip(found, w, times, strict=True):
        blocks = max(1, min(MOST_BLOCKS, r.n // BLOCK_ROWS))
        whole = math.floor(e + 1e-9)
        plan.append((r.s, float(x), whole, float(r.t * (e - whole)) if e - whole > 1e-9 else 0.0, float(r.t * e), blocks))
    spark = docs.sparkSession
    source_type = kept.schema[source_col].dataType.simpleString()
    table = spark.createDataFrame(plan, f"__s {source_type}, weight double, __whole int, __rest double, __budget double, __blocks int")

    salted = any(r.most > MOST_ALIKE for r in found)
    dealt = materialise(kept.withColumn("__salt", F.floor(F.rand(seed) * (1 << 30)).cast("long"))) if salted else kept.withColumn("__salt", F.lit(0).cast("long"))
    dealt = dealt.withColumns({"n_tokens": n_tokens, "__h": F.xxhash64(F.col(id_col), text, "__salt")})
    dealt = dealt.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col("__s")))
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64("__h", F.lit(seed)), F.col("__blocks")).cast("int"))
    every_epoch = F.explode(F.sequence(F.lit(0), F.col("__whole") - F.when(F.col("__rest") > 0, 0).otherwise(1)))
    copies = dealt.withColumn("epoch", every_epoch)

    # lengths of the blocks: one row for each source and block, the same in every epoch
    length = dealt.groupBy(F.col("__s").alias("__s2"), F.col("__b").alias("__b2"), "__whole", "__rest").agg(F.count("*").alias("__n"), F.sum("n_tokens").alias("__t"))
    length = length.withColumn("__e2", every_epoch)
    shuffled = Window.partitionBy("__s2", "__e2").orderBy(F.xxhash64("__b2", "__e2", F.lit(seed + 1)), "__b2")
    earlier = shuffled.rowsBetween(Window.unboundedPreceding, -1)
    before = length.select(
        "__s2", "__b2", "__e2", (F.row_number().over(shuffled) - 1).alias("block"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n_before"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__t_before"),
    )

    inner = Window.partitionBy("__s", "epoch", "__b").orderBy(F.xxhash64("__h", "epoch", F.lit(seed + 2)), F.col(id_col), "__h", "n_tokens")
    placed = copies.withColumns({"__i": F.row_number().over(inner) - 1, "__u": F.coalesce(F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    if sum(b * (whole + 1) for _, _, whole, _, _, b in plan) <= 200_000:  # a dozen megabytes
        before = F.broadcast(before)
    placed = placed.join(before, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__b") == F.col("__b2")) & (F.col("epoch") == F.col("__e2")))
    read = F.col("__t_before") + F.col("__u")
    placed = placed.withColumn("__read", read.cast("double")).where((F.col("epoch") < F.col("__whole")) | (F.col("__read") < F.col("__rest")))
    per_epoch = F.when(F.col("__budget") > 0, F.try_divide(F.col("__budget") - F.col("__rest"), F.col("__whole"))).otherwise(0.0)
    return placed.withColumns({
        "position": (F.col("__n_before") + F.col("__i")).cast("long"),
        "mix_key": F.when(F.col("__budget") > 0, F.try_divide(F.col("epoch") * per_epoch + F.col("__read"), F.col("__budget"))).otherwise(0.0),
        "exponent": F.lit(float(a)), "entropy": F.lit(float(spread(w))), "repetition": F.lit(float(max(times, default=1.0))),
    }).select(*[F.col(f"`{c}`") for c in kept.columns], *OUT)
