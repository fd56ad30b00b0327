"""Line connectivity: which end points touch other features, by a join on a grid of levels.

Cells double in size from level to level.  A segment lies on the level where it
is at most ``REACH`` cells long and covers the cells that it passes there, widened
by the tolerance, so it makes a few dozen rows at most, whatever its length; a
point looks once at each level in use.  Rows therefore grow in proportion to
segments and points.  They meet by an equi-join on level and cell with the exact
distance as residual condition, in a semi or anti join, so no pair is ever
emitted.  Equal end points of one owner are looked up once, equal segments lie on
the grid once for all their owners, end points that coincide with a vertex of
another owner are found by their coordinates alone, and Spark may split a crowded
cell.  Spark estimates rows on the grid by the rows that they are made of, a
hundred times too low, so these joins are sort-merge joins by hint: the table of
cells would otherwise be broadcast through the driver.

Few rows reach a shuffle.  Tables of ``BITS`` bits, whatever the input, say which
wide cells have a point to be looked up and which places may be one owner's alone;
segments put cells down only in wide cells that have a point, and end points at
places of several owners are connected without a join.  A bit that two keys share
lets a row too many through and never loses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.geometry import distance2

#: Cells that a segment is long at most, on its level.
REACH = 16

#: Cells of a level that a wide cell has on each side.
WIDE = 4

#: Bits of a table of keys (512 KB).
BITS = 1 << 22


def _cell(v: Column, h: Column) -> Column:
    return F.floor(v / h).cast("long")


def _margin(tolerance: float) -> float:
    return tolerance * 1.000001 + 1e-9


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: as rows of a generator they are not copied into every expression that names them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _bit(key: Column) -> tuple[Column, Column]:
    """(word, bit in it) of a key's hash."""
    bit = key.bitwiseAND(F.lit(BITS - 1))
    return F.shiftright(bit, 6).cast("int"), bit.bitwiseAND(F.lit(63)).cast("int")


def bits_of(df: DataFrame, key: Column) -> Column:
    """The hashes of key in df as a table of bits: an array of BITS / 64 words, as a scalar subquery."""
    word, bit = _bit(key)
    none = df.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    mine = df.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    words = mine.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w")["bits"]).scalar()


def may_be_in(bits: Column, key: Column) -> Column:
    """Whether the bit of a key's hash is set."""
    word, bit = _bit(key)
    return F.getbit(F.get(bits, word), bit) == 1


def _wide() -> Column:
    return F.xxhash64("level", "wx", "wy")


def levels_of(segments: DataFrame, base: float | Column) -> DataFrame:
    """segments (x1, y1, x2, y2, ...) with ``level`` and ``cell``: cells of a level are base * 2^level wide."""
    longer = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    based = _with(segments, base=F.lit(base))
    leveled = _with(based, level=F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longer, "base") / (REACH * F.col("base"))))).cast("int"))
    return _with(leveled, cell=F.col("base") * F.pow(F.lit(2.0), "level")).drop("base")


def _passed(segments: DataFrame, t: float, names: tuple[str, str], within: tuple[str, str] | None = None) -> DataFrame:
    """segments (..., cell) once for each wide cell that they come near to (names), or for each cell in a wide one (within)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cell = F.col("cell") if within is not None else F.col("cell") * WIDE

    def each(df: DataFrame, a: Column, b: Column, i: int) -> DataFrame:
        first, last = _cell(a, cell), _cell(b, cell)
        if within is not None:
            first, last = F.greatest(first, F.col(within[i]) * WIDE), F.least(last, F.col(within[i]) * WIDE + (WIDE - 1))
        return _with(df, first=first, last=last).where("first <= last").withColumn(names[i], F.explode(F.sequence("first", "last"))).drop("first", "last")

    columns = each(segments, F.least(x1, x2) - t, F.greatest(x1, x2) + t, 0)
    low, high = F.greatest(F.col(names[0]) * cell - t, F.least(x1, x2)), F.least((F.col(names[0]) + 1) * cell + t, F.greatest(x1, x2))
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - x1, x2 - x1))))
    columns = _with(columns, a=at(low), b=at(high))
    below = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.least("a", "b")) - t
    above = F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.greatest("a", "b")) + t
    return each(columns, below, above, 1).drop("a", "b")


def _wide_cells(segments: DataFrame, tolerance: float, base: float | Column, bits: Column | None) -> DataFrame:
    """segments with level and cell, once for each wide cell (wx, wy) that they come near to; bits: only those that may have a point."""
    wide = _passed(levels_of(segments, base), _margin(tolerance), ("wx", "wy"))
    return wide if bits is None else wide.where(may_be_in(bits, _wide()))


def covered(segments: DataFrame, tolerance: float, base: float | Column, bits: Column | None = None) -> DataFrame:
    """segments (owner, x1, y1, x2, y2) once for each cell (level, cx, cy) that they come near to; bits: only in wide cells that may have a point."""
    return _passed(_wide_cells(segments, tolerance, base, bits), _margin(tolerance), ("cx", "cy"), ("wx", "wy")).drop("wx", "wy", "cell")


def _extent(segments: DataFrame) -> DataFrame:
    """One row (base, longest): see extent."""
    longer = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    r = segments.agg(F.count("*").alias("n"), F.percentile_approx("x1", [0.05, 0.95]).alias("x"), F.percentile_approx("y1", [0.05, 0.95]).alias("y"), F.max(F.when(~F.isnan(longer), longer)).alias("longest"))
    side = lambda c: F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(0.0))
    known = (F.col("n") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    base = F.when(known, F.greatest(F.sqrt(side("x") * side("y") / (0.81 * F.col("n"))), F.lit(1e-9))).otherwise(1.0)
    return r.select(base.alias("base"), F.when(known, F.coalesce("longest", F.lit(0.0))).otherwise(0.0).alias("longest"))


def extent(segments: DataFrame) -> tuple[float, float]:
    """(about the distance between neighbouring ends: the side of a square with one end in it, outliers left out; the longest side of a segment)."""
    r = _extent(segments).head()
    return r.base, r.longest


def merged(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join."""
    return df.hint("merge")


def by_place(df: DataFrame, *place: str) -> DataFrame:
    """The distinct places with the smallest and largest owner (lo, hi) and whether there is a null one (nobody)."""
    return df.groupBy(*place).agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max(F.col("owner").isNull()).alias("nobody"))


def _foreign() -> Column:
    """Whether a place (lo, hi, nobody) has another owner than ``owner``; null is an owner like others."""
    owner = F.col("owner")
    return F.when(owner.isNull(), F.col("lo").isNotNull()).otherwise(F.col("nobody") | (F.col("lo") != owner) | (F.col("hi") != owner))


def _sane(*names: str) -> Column:
    """Whether no coordinate is null or NaN."""
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def _looks(points: DataFrame, base: Column, longest: Column) -> DataFrame:
    """points (x, y, ...) once for each level in use, with ``cell``; a null or NaN coordinate is nowhere."""
    based = _with(points.where(_sane("x", "y")), base=base, longest=longest)
    top = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("longest", "base") / (REACH * F.col("base")))).cast("int")) + 1
    leveled = based.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    return _with(leveled, cell=F.col("base") * F.pow(F.lit(2.0), "level")).drop("base", "longest")


def hits(points: DataFrame, segments: DataFrame, tolerances: tuple[float, ...], base: float | Column, longest: float | Column, places: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """For each of the rising tolerances the distinct (owner, x, y) of points within it (inclusive) of a segment of another owner, and of none before.

    base: the width of the smallest cells; longest: the longest side of a segment, which says how many levels there are;
    places: (x, y, ...) of all points and perhaps some more, if they are easier to have than points.
    Points and segments with a null or NaN coordinate touch nothing.  The rows of the grid are those of the largest
    tolerance, the same for all, so that they are shuffled once.
    """
    most = max(tolerances)
    base, longest = F.greatest(F.lit(base), F.lit(4.0 * most)), F.lit(longest)
    x, y, cell = (F.col(c) for c in ("x", "y", "cell"))
    seen = _looks((points if places is None else places).select("x", "y"), base, longest)
    bits = bits_of(seen.select("level", _cell(x, cell * WIDE).alias("wx"), _cell(y, cell * WIDE).alias("wy")), _wide())
    # one long for level and cell: where two cells share one, the exact distance tells them apart
    place = F.xxhash64("level", "cx", "cy")
    # a segment is here once for each of its wide cells, until equal ones become one
    close = _wide_cells(segments.where(_sane("x1", "y1", "x2", "y2")), most, base, bits)
    s = merged(covered(by_place(close, "x1", "y1", "x2", "y2"), most, base, bits).select("lo", "hi", "nobody", "x1", "y1", "x2", "y2", place.alias("s_place")))
    away = distance2(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    points, found = points.select("owner", "x", "y").distinct(), []
    for t in tolerances:
        if found:
            same, is_same = _same_point(found[-1])
            points = points.join(same, is_same, "left_anti")
        looks = _looks(points, base, longest).withColumns({"cx": _cell(x, cell), "cy": _cell(y, cell)}).select("owner", "x", "y", place.alias("place"))
        found.append(looks.join(s, (F.col("place") == F.col("s_place")) & _foreign() & (away <= t * t), "left_semi").select("owner", "x", "y").distinct())
    return tuple(found)


def _same_point(hit: DataFrame) -> tuple[DataFrame, Column]:
    named = hit.toDF("h_owner", "hx", "hy")
    return merged(named), F.col("owner").eqNullSafe(F.col("h_owner")) & (F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy"))


def as_points(points: DataFrame) -> DataFrame:
    """Points (owner, x, y) as segments without length."""
    return points.select("owner", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def open_places(lines: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The places (x, y, lo, hi, nobody) of ends without vertices of two owners, so that an end there may be alone."""
    corners = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])
    ends = F.coalesce("ends", F.array().cast(lines.schema["ends"].dataType))
    whole = F.expr("not (isnan(x1) or isnan(y1) or isnan(x2) or isnan(y2))")
    spots = lines.select("owner", F.size(ends).alias("n"), whole.alias("whole"), F.posexplode(F.concat(ends, corners)).alias("k", "e"))
    spots = spots.select("owner", F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.expr("k >= n and whole").alias("vertex"), F.expr("k < n").alias("end"))
    if points is not None:
        spots = spots.unionByName(points.select("owner", "x", "y", F.expr("not (isnan(x) or isnan(y))").alias("vertex"), F.lit(False).alias("end")))
    mine, nobodys = F.when(F.col("vertex"), F.col("owner")), F.col("vertex") & F.col("owner").isNull()
    places = spots.groupBy("x", "y").agg(F.min(mine).alias("lo"), F.max(mine).alias("hi"), F.max(nobodys).alias("nobody"), F.max("end").alias("end"))
    return places.where("end and (x is null or y is null or lo is null or (lo = hi and not nobody))").drop("end")


def endpoint_states(lines: DataFrame, points: DataFrame | None = None, snap: float = 0.001, near: float = 0.5) -> DataFrame:
    """(layer, owner, x, y, n, state) of the distinct end points of lines (layer, owner, x1, y1, x2, y2, ends).

    ``ends`` is an array of structs (x, y): the end points that the row contributes; points: (owner, x, y) of other features.
    state: connected (within snap of another feature), near miss (within near) or dangle; n: how often it occurs.
    All is one plan, without a persisted table: Spark shuffles what parts of it share once.
    """
    ends = lines.select("layer", "owner", F.explode("ends").alias("e")).groupBy("layer", "owner", F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(F.count("*").alias("n"))
    targets = lines.select("owner", "x1", "y1", "x2", "y2")
    measures = _extent(targets).select(F.struct("base", "longest")).scalar()
    if points is not None:
        targets = targets.unionByName(as_points(points))
    places, place = open_places(lines, points), F.xxhash64("x", "y")
    may_be_open = may_be_in(bits_of(places, place), place)
    at = merged(places.select(F.col("x").alias("vx"), F.col("y").alias("vy"), "lo", "hi", "nobody", F.lit(True).alias("open")))
    some = ends.where(may_be_open).join(at, F.col("x").eqNullSafe(F.col("vx")) & F.col("y").eqNullSafe(F.col("vy")), "left")
    # at a place that is not open there are vertices of two owners, so that an end there meets one of another owner
    met = F.col("open").isNull() | (F.col("x").isNotNull() & F.col("y").isNotNull() & F.coalesce(_foreign(), F.lit(False)))
    some = some.select("layer", "owner", "x", "y", "n", met.alias("met"))
    snapped, missed = hits(some.where("not met"), targets, (snap, near), measures["base"], measures["longest"], places)
    snapped, same = _same_point(snapped)
    missed = merged(missed.toDF("m_owner", "mx", "my"))
    close = F.col("owner").eqNullSafe(F.col("m_owner")) & (F.col("x") == F.col("mx")) & (F.col("y") == F.col("my"))
    state = F.when(F.col("met") | F.col("hx").isNotNull(), "connected").when(F.col("mx").isNotNull(), "near miss").otherwise("dangle")
    looked = some.join(snapped, same, "left").join(missed, close, "left").select("layer", "owner", "x", "y", "n", state.alias("state"))
    return looked.unionByName(ends.where(~may_be_open).withColumn("state", F.lit("connected")))


def connectivity(states: DataFrame) -> DataFrame:
    """(layer, endpoints, near_miss, dangles, score)."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).cast("long")
    rows = states.groupBy("layer").agg(F.sum("n").cast("long").alias("endpoints"), n("near miss").alias("near_miss"), n("dangle").alias("dangles"))
    return rows.withColumn("score", 100.0 * (1.0 - F.least(F.lit(1.0), (5.0 * F.col("near_miss") + 0.5 * F.col("dangles")) / F.col("endpoints"))))


def orphan_points(points: DataFrame, segments: DataFrame, snap: float = 0.001) -> DataFrame:
    """Points (owner, x, y, ...) that touch no segment."""
    measures = _extent(segments).select(F.struct("base", "longest")).scalar()
    anyone = segments.withColumn("owner", F.lit(None).cast(points.schema["owner"].dataType))
    # owners do not matter here: null stands for that of all segments, and points are looked up by place
    named = points.select(F.lit("-").alias("owner"), "x", "y")
    hit, _ = _same_point(hits(named, anyone.withColumn("owner", F.col("owner").cast("string")), (snap,), measures["base"], measures["longest"])[0])
    return points.join(merged(hit.select("hx", "hy")), (F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy")), "left_anti")


def stacked_points(points: DataFrame, digits: int = 4) -> DataFrame:
    """(x, y, members): rounded places with more than one point."""
    return points.groupBy(F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).agg(F.count("*").alias("members")).where("members > 1")


def z_statistics(df: DataFrame, z: Column, *by: str) -> DataFrame:
    """(by..., vertices, zero, flat): flat where at least 99.9 % of the heights are zero, NaN or missing."""
    zero = F.coalesce((z == 0) | F.isnan(z), F.lit(True))
    n = df.groupBy(*by).agg(F.count("*").alias("vertices"), F.count_if(zero).alias("zero"))
    return n.withColumn("flat", (F.col("vertices") == 0) | (F.col("zero") >= 0.999 * F.col("vertices")))
