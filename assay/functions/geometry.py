"""Geometry as columns: a shape is ``array<array<array<struct<x, y, z>>>>``; measures are built-in expressions.

Levels: parts (points, lines or polygons), their rings (a point's or a line's only
one; of a polygon the shell, then the holes), vertices.  WKB is decoded by an Arrow
UDF (Spark has no parser for it); validity of rings and lines needs segment
intersections and is a small numpy UDF.  Null and empty shapes have length and
area 0 and no end points.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

VERTEX = "struct<x:double,y:double,z:double>"
SHAPE = f"array<array<array<{VERTEX}>>>"
_SHAPE = ArrayType(ArrayType(ArrayType(StructType([StructField(c, DoubleType()) for c in "xyz"]))))


def _parts(data: memoryview | bytes) -> list[list[np.ndarray]] | None:
    """Parts of a WKB point, line, polygon or multi of these as lists of rings, each an array with a row for a vertex; None if it cannot be read."""

    def read(at: int):
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        has_z, has_m = bool(code & 0x80000000) or 1000 <= code % 0x10000 < 2000 or 3000 <= code % 0x10000, bool(code & 0x40000000) or 2000 <= code % 0x10000
        kind, dims = (code & 0xFFFF) % 1000, 2 + has_z + has_m

        def run(n: int, at: int):
            return np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, : 2 + has_z], at + 8 * n * dims

        def count(at: int):
            return struct.unpack_from(order + "I", data, at)[0], at + 4

        if kind == 1:
            ring, at = run(1, at)
            return ([[ring]] if ring[0, 0] == ring[0, 0] else []), at
        n, at = count(at)
        if kind == 2:
            ring, at = run(n, at)
            return ([[ring]] if n else []), at
        inner: list = []
        for _ in range(n):
            if kind == 3:
                m, at = count(at)
                ring, at = run(m, at)
                inner.append(ring)
            else:
                parts, at = read(at)
                inner += parts
        return ([inner] if inner else []) if kind == 3 else inner, at

    try:
        return read(0)[0]
    except (struct.error, IndexError, ValueError, RecursionError):
        return None


def _shapes(wkb: pa.Array) -> pa.Array:
    """The shapes of a binary column: rings stay arrays, of which each level's offsets and one array of vertices are made."""
    shapes = [None if b is None else _parts(b) for b in (memoryview(v.as_buffer()) if v.is_valid else None for v in wkb)]
    parts = [part for shape in shapes if shape for part in shape]
    rings_ = [ring for part in parts for ring in part]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.fromiter(sizes, "i8", -1))]).astype("i4"))
    column = lambda k: np.concatenate([np.empty(0), *[r[:, k] if k < r.shape[1] else np.zeros(len(r)) for r in rings_]]).astype("f8", copy=False)
    flat = np.repeat([r.shape[1] < 3 for r in rings_] or [False], [len(r) for r in rings_] or [0])
    vertices_ = pa.StructArray.from_arrays([pa.array(column(0)), pa.array(column(1)), pa.array(column(2), mask=flat)], names=["x", "y", "z"])
    by_ring = pa.ListArray.from_arrays(ends(len(r) for r in rings_), vertices_)
    by_part = pa.ListArray.from_arrays(ends(len(p) for p in parts), by_ring)
    return pa.ListArray.from_arrays(ends(len(s or ()) for s in shapes), by_part, mask=pa.array([s is None for s in shapes], pa.bool_()))


@F.arrow_udf(_SHAPE)
def from_wkb(c: pa.Array) -> pa.Array:
    return _shapes(c)


def rings(shape: Column) -> Column:
    return F.coalesce(F.flatten(shape), F.array().cast(f"array<array<{VERTEX}>>"))


def vertices(shape: Column) -> Column:
    return F.flatten(rings(shape))


def is_empty(shape: Column) -> Column:
    return shape.isNull() | (F.size(vertices(shape)) == 0)


def has_z(shape: Column) -> Column:
    """Whether any vertex has a height; false for null and empty shapes."""
    return F.exists(vertices(shape), lambda v: v.z.isNotNull())


def _steps(part: Column, value) -> Column:
    """Sum of value(a, b) over consecutive vertices."""
    pairs = F.when(F.size(part) > 1, F.zip_with(F.slice(part, F.lit(1), F.size(part) - 1), F.slice(part, F.lit(2), F.size(part) - 1), value)).otherwise(F.array().cast("array<double>"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def length(shape: Column) -> Column:
    each = F.transform(rings(shape), lambda p: _steps(p, lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def _ring_area(ring: Column) -> Column:
    closed = F.when(F.size(ring) > 0, F.concat(ring, F.array(F.element_at(ring, 1)))).otherwise(ring)
    return F.abs(_steps(closed, lambda a, b: a.x * b.y - b.x * a.y)) / 2


def area(shape: Column) -> Column:
    """Sum over the parts of the shell's area less its holes'; a ring that is not closed counts as if it were, so a line of two vertices has none."""
    holes = lambda part: F.aggregate(F.slice(part, 2, 1_000_000), F.lit(0.0), lambda s, r: s + _ring_area(r))
    each = F.transform(F.filter(shape, lambda p: F.size(p) > 0), lambda p: _ring_area(F.element_at(p, 1)) - holes(p))
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def ends(shape: Column) -> Column:
    """First and last vertex of each line, to be exploded."""
    return F.flatten(F.transform(F.filter(rings(shape), lambda p: F.size(p) > 0), lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1))))


def segments(shape: Column) -> Column:
    """Consecutive vertices of each ring as (x1, y1, x2, y2), to be exploded."""
    step = lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))
    return F.flatten(F.transform(F.filter(rings(shape), lambda p: F.size(p) > 1), lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), step)))


def simplified(shape: Column, tolerance: Column | float) -> Column:
    """Vertices nearer than tolerance to the last one kept are left out of each ring, its first and last vertex never."""

    def thin(ring: Column) -> Column:
        def step(kept: Column, v: Column) -> Column:
            last = F.element_at(kept, -1)
            far = (v.x - last.x) * (v.x - last.x) + (v.y - last.y) * (v.y - last.y) >= F.lit(tolerance) * F.lit(tolerance)
            return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(v))).otherwise(kept)

        inner = F.aggregate(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, 1, 0), step)
        return F.when(F.size(ring) > 2, F.concat(inner, F.array(F.element_at(ring, -1)))).otherwise(ring)

    return F.transform(shape, lambda part: F.transform(part, thin))


def distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x1) * dx + (py - y1) * dy, size)))).otherwise(0.0)
    return (px - (x1 + t * dx)) * (px - (x1 + t * dx)) + (py - (y1 + t * dy)) * (py - (y1 + t * dy))


def _crosses(p: np.ndarray, closed: bool) -> bool:
    """Whether two segments of a vertex run meet anywhere but in a shared vertex of neighbours; one sorted sweep over x, numpy inside."""
    a, b = p[:-1], p[1:]
    keep = np.any(a != b, axis=1)
    a, b = a[keep], b[keep]
    n = len(a)
    if n < 2:
        return False
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    starts = low[order, 0]

    def turn(o, u, v):
        return np.sign((u[:, 0] - o[:, 0]) * (v[:, 1] - o[:, 1]) - (u[:, 1] - o[:, 1]) * (v[:, 0] - o[:, 0]))

    for k, i in enumerate(order):
        j = order[k + 1 : np.searchsorted(starts, high[i, 0], "right")]
        j = j[(low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])]
        if not len(j):
            continue
        ai, bi = np.broadcast_to(a[i], (len(j), 2)), np.broadcast_to(b[i], (len(j), 2))
        d1, d2, d3, d4 = turn(ai, bi, a[j]), turn(ai, bi, b[j]), turn(a[j], b[j], ai), turn(a[j], b[j], bi)
        meet = (d1 * d2 <= 0) & (d3 * d4 <= 0)
        near = (np.abs(j - i) == 1) | (closed & (np.abs(j - i) == n - 1))
        # neighbours share a vertex; they overlap only if they are collinear and point back
        back = (d1 == 0) & (d2 == 0) & (np.sum((bi - ai) * (b[j] - a[j]), axis=1) < 0)
        if np.any(meet & np.where(near, back, True)):
            return True
    return False


def _meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two rings cross: segments that pass through each other, or overlap along a line; touching in a point is no crossing."""
    turn = lambda o, u, v: np.sign((u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0]))
    c, d = q[:-1], q[1:]
    for a, b in zip(p[:-1], p[1:], strict=True):
        d1, d2, d3, d4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        if np.any((d1 * d2 < 0) & (d3 * d4 < 0)):
            return True
        along = np.flatnonzero((d1 == 0) & (d2 == 0))
        t = (b - a) @ (b - a)
        if len(along) and t > 0:
            s = np.sort(np.stack([(c[along] - a) @ (b - a), (d[along] - a) @ (b - a)]) / t, axis=0)
            if np.any(np.minimum(s[1], 1) - np.maximum(s[0], 0) > 0):
                return True
    return False


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    """Whether the first vertex of p that is not on the ring lies in it; true if all are on it."""
    a, b = ring[:-1], ring[1:]
    for x, y in p:
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        low, high = np.minimum(a, b), np.maximum(a, b)
        if np.any((cross == 0) & (low[:, 0] <= x) & (x <= high[:, 0]) & (low[:, 1] <= y) & (y <= high[:, 1])):
            continue
        up = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        return bool(np.count_nonzero(up & (x < at)) % 2)
    return True


def _reason(kind: str, parts) -> str | None:
    shells = []
    for part in parts if parts is not None else ():
        polygon = [np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2) for ring in part]
        for p in polygon:
            if not np.isfinite(p).all():
                return "Invalid Coordinate"
            if "line" in kind and len(np.unique(p, axis=0)) < 2:
                return "Too few points in geometry component"
            if "polygon" in kind:
                if len(p) < 4 or len(np.unique(p, axis=0)) < 3:
                    return "Too few points in geometry component"
                if (p[0] != p[-1]).any():
                    return "Points of LinearRing do not form a closed linestring"
                if _crosses(p, True):
                    return "Self-intersection"
        if "polygon" not in kind or not polygon:
            continue
        shell, *holes = polygon
        if any(_meet(p, q) for i, p in enumerate(polygon) for q in polygon[:i]):
            return "Self-intersection"
        if not all(_inside(h, shell) for h in holes):
            return "Hole lies outside shell"
        if any(_inside(h, g) for h in holes for g in holes if h is not g):
            return "Holes are nested"
        shells.append(polygon)
    for i, (p, *_) in enumerate(shells):
        for q, *holes in (x for k, x in enumerate(shells) if k != i):
            if _meet(p, q):
                return "Self-intersection"
            if _inside(p, q) and not any(_inside(p, h) for h in holes):
                return "Nested shells"
    return None


@F.pandas_udf(StringType())
def invalid_reason(kind: pd.Series, shape: pd.Series) -> pd.Series:
    """Why a line or polygon is not valid; null if it is, for points, and for null or empty shapes."""
    return pd.Series([_reason((k or "").lower(), s) for k, s in zip(kind, shape, strict=True)], dtype=object)


def geojson(kind: Column, shape: Column, properties: Column) -> Column:
    """A GeoJSON feature as text, two dimensions; a multi kind where there are several parts, null geometry for empty shapes."""
    low = F.lower(kind)
    joined = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    run = lambda ring: joined(F.transform(ring, lambda v: F.concat(F.lit("["), v.x.cast("string"), F.lit(","), v.y.cast("string"), F.lit("]"))))
    line = lambda part: run(F.element_at(part, 1))
    point = lambda part: F.regexp_extract(line(part), r"^\[(.*)\]\z", 1)
    polygon = lambda part: joined(F.transform(part, run))
    parts = F.filter(shape, lambda p: F.size(F.flatten(p)) > 0)

    def body(name: str, one) -> Column:
        every = F.transform(parts, one)
        single = F.concat(F.lit(f'{{"type":"{name}","coordinates":'), F.element_at(every, 1), F.lit("}"))
        return F.when(F.size(parts) == 1, single).otherwise(F.concat(F.lit(f'{{"type":"Multi{name}","coordinates":'), joined(every), F.lit("}")))

    geometry = F.when(low.contains("polygon"), body("Polygon", polygon)).when(low.contains("line"), body("LineString", line)).otherwise(body("Point", point))
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.when(is_empty(shape), "null").otherwise(geometry), F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def moved(shape: Column, change) -> Column:
    """The shape with change(x, y), a struct of both, applied to its vertices; heights stay."""

    def vertex(v: Column) -> Column:
        return F.element_at(F.transform(F.array(change(v.x, v.y)), lambda c: F.struct(c.x.alias("x"), c.y.alias("y"), v.z.alias("z"))), 1)

    return F.transform(shape, lambda part: F.transform(part, lambda ring: F.transform(ring, vertex)))


def point(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("double").alias("z")))))
