"""Map projections both ways as column expressions, with constants from a WKT coordinate system.

Transverse Mercator (hence UTM) by Krüger's series to the sixth order of the third
flattening, Lambert conformal conic with one or two standard parallels, Mercator
(ellipsoidal, and the spherical one of web maps).  All of them pass through the
isometric latitude psi = asinh(tan(lat)) - e * atanh(e * sin(lat)), which has no
branches; the way back is a series in sines, so neither way needs iteration.  What a
formula uses more than once is bound first (``let``), so expressions stay small.

``parse`` reads a system once, on the driver (WKT 1 with the names of its dialects,
and WKT 2); ``between`` gives the change from one system to another.  Systems are
taken as lying on one datum: ellipsoids are honoured, datum shifts (a metre or two
between WGS 84 and NAD 83) are not made.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (x, y) -> struct(x, y)
Change = Callable[[Column, Column], Column]

# Coefficients of Krüger's series; row j, column k stands for sin(2j) or sinh(2j) and n ** (j + k).
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
#: From the conformal latitude back to the geodetic one.
LATITUDE = ((2.0, -2 / 3, -2.0, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))

# Names of parameters and methods in the dialects of WKT, by what they mean here.
PARAMETERS = {
    "latitude_of_origin": "lat0", "latitude_of_natural_origin": "lat0", "latitude_of_false_origin": "lat0", "latitude_of_center": "lat0",
    "central_meridian": "lon0", "longitude_of_natural_origin": "lon0", "longitude_of_false_origin": "lon0", "longitude_of_center": "lon0", "longitude_of_origin": "lon0",
    "scale_factor": "k0", "scale_factor_at_natural_origin": "k0",
    "false_easting": "fe", "easting_at_false_origin": "fe", "false_northing": "fn", "northing_at_false_origin": "fn",
    "standard_parallel_1": "sp1", "latitude_of_1st_standard_parallel": "sp1", "standard_parallel_2": "sp2", "latitude_of_2nd_standard_parallel": "sp2",
}
METHODS = {
    "transverse_mercator": "tm", "gauss_kruger": "tm", "transverse_mercator_gauss_kruger": "tm",
    "lambert_conformal_conic": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic_2sp": "lcc", "lambert_conic_conformal_1sp": "lcc", "lambert_conic_conformal_2sp": "lcc",
    "mercator": "merc", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator_variant_a": "merc", "mercator_variant_b": "merc",
    "mercator_auxiliary_sphere": "web", "popular_visualisation_pseudo_mercator": "web", "pseudo_mercator": "web",
}


@dataclass(frozen=True)
class Projection:
    """A horizontal system: method ("" for degrees), ellipsoid, angles in radians, lengths in metres, metres in a unit."""

    method: str
    a: float
    f: float
    unit: float = 1.0
    lat0: float = 0.0
    lon0: float = 0.0
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    sp1: float | None = None
    sp2: float | None = None
    #: of a geographic system: radians in a unit
    angle: float = field(default=math.pi / 180)

    @property
    def e(self) -> float:
        return 0.0 if self.method == "web" else math.sqrt(self.f * (2 - self.f))

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def rectifying(self) -> float:
        """Radius of the rectifying sphere."""
        return self.a / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64 + self.n**6 / 256)

    def psi(self, lat: float) -> float:
        return math.asinh(math.tan(lat)) - self.e * math.atanh(self.e * math.sin(lat))

    def m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.e * math.sin(lat)) ** 2)

    def cone(self) -> tuple[float, float, float]:
        """(exponent, radius at psi = 0, radius at the origin) of the Lambert cone."""
        if self.sp2 is None or self.sp2 == self.sp1:  # one parallel, possibly with a scale
            at = self.lat0 if self.sp1 is None else self.sp1
            n, m, psi = math.sin(at), self.m(at), self.psi(at)
        else:
            n = (math.log(self.m(self.sp1)) - math.log(self.m(self.sp2))) / (self.psi(self.sp2) - self.psi(self.sp1))
            m, psi = self.m(self.sp1), self.psi(self.sp1)
        radius = self.k0 * self.a * m / n * math.exp(n * psi)
        return n, radius, radius * math.exp(-n * self.psi(self.lat0))


def series(table: tuple[tuple[float, ...], ...], n: float) -> list[float]:
    return [sum(c * n ** (j + k) for k, c in enumerate(row, 1)) for j, row in enumerate(table)]


def parse(wkt: str | None) -> Projection | None:
    """The horizontal part of a WKT system; None where it has no ellipsoid or a method that is not known here."""
    flat = re.sub(r"(?is),?\s*(VERT_?CS|VERTCRS)\[.*$", "", wkt or "")
    globe = re.search(r'(?i)(?:SPHEROID|ELLIPSOID)\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+)\s*,\s*([0-9.eE+-]+)(?:\s*,\s*LENGTHUNIT\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+))?', flat)
    if globe is None:
        return None
    a, rf = float(globe[1]) * float(globe[3] or 1), float(globe[2])
    f = 1 / rf if rf else 0.0
    units = re.findall(r'(?i)(?<![A-Z])(?:LENGTH)?UNIT\[\s*"([^"]*)"\s*,\s*([0-9.eE+-]+)', flat)
    if not re.search(r"(?i)PROJ(CS|CRS)\[", flat):
        angles = re.findall(r'(?i)(?:ANGLE)?UNIT\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+)', flat)
        return Projection("", a, f, angle=float(angles[-1]) if angles else math.pi / 180)
    named = re.search(r'(?i)(?:PROJECTION|METHOD)\[\s*"([^"]*)"', flat)
    method = METHODS.get(re.sub(r"[^a-z0-9]+", "_", named[1].lower()).strip("_")) if named else None
    if method is None:
        return None
    unit = float(units[-1][1]) if units else 1.0
    known: dict[str, float] = {}
    for name, value, kind, factor in re.findall(r'(?i)PARAMETER\[\s*"([^"]*)"\s*,\s*([0-9.eE+-]+)(?:\s*,\s*(LENGTH|ANGLE|SCALE)UNIT\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+))?', flat):
        what = PARAMETERS.get(re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_"))
        if what in ("fe", "fn"):
            known[what] = float(value) * (float(factor) if kind.upper() == "LENGTH" else unit)
        elif what == "k0":
            known[what] = float(value)
        elif what:
            known[what] = float(value) * (float(factor) if kind.upper() == "ANGLE" else math.pi / 180)
    return Projection(method, a, f, unit, **known)


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body(values), each value computed once."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(bound), lambda r: body(*[r[f"v{i}"] for i in range(len(values))])), 1)


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def isometric(lat: Column, e: float) -> Column:
    plain = F.asinh(F.tan(lat))
    return plain - F.atanh(F.sin(lat) * e) * e if e else plain


def geodetic(chi: Column, p: Projection) -> Column:
    """Latitude of a conformal one."""
    out = chi
    for j, c in enumerate(series(LATITUDE, p.n) if p.e else (), 1):
        out = out + F.sin(chi * (2 * j)) * c
    return out


def _turned(lon: Column) -> Column:
    """An angle between -pi and pi."""
    return lon - F.floor((lon + math.pi) / (2 * math.pi)) * (2 * math.pi)


def _start(p: Projection) -> float:
    """Rectifying latitude of the origin."""
    chi = math.atan(math.sinh(p.psi(p.lat0)))
    return chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(series(FORWARD, p.n), 1))


def _waves(xi: Column, eta: Column, table, p: Projection, sign: int) -> tuple[Column, Column]:
    north, east = xi, eta
    for j, c in enumerate(series(table, p.n), 1):
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * (sign * c)
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * (sign * c)
    return north, east


def forward(p: Projection) -> Change:
    """(longitude, latitude) in radians -> coordinates of p."""
    placed = lambda x, y: _xy((x + p.fe) / p.unit, (y + p.fn) / p.unit)
    k = p.k0 * (p.m(p.sp1) if p.sp1 else 1.0)
    rise = p.psi(p.lat0) if p.method == "merc" and p.sp1 is None else 0.0

    def transverse(far: Column, psi: Column) -> Column:
        t, size = F.sinh(psi), p.k0 * p.rectifying
        xi, eta = F.atan2(t, F.cos(far)), F.asinh(F.sin(far) / F.sqrt(t * t + F.cos(far) * F.cos(far)))
        waves = let(lambda a, b: F.struct(*[v.alias(n) for v, n in zip(_waves(a, b, FORWARD, p, 1), ("north", "east"), strict=True)]), xi, eta)
        return let(lambda w: placed(w.east * size, (w.north - _start(p)) * size), waves)

    def conic(far: Column, psi: Column) -> Column:
        n, radius, origin = p.cone()
        return let(lambda r: placed(r * F.sin(far * n), F.lit(origin) - r * F.cos(far * n)), F.exp(psi * -n) * radius)

    def cylinder(far: Column, psi: Column) -> Column:
        return placed(far * (p.a * k), (psi - rise) * (p.a * k))

    if not p.method:
        return lambda lon, lat: _xy(lon / p.angle, lat / p.angle)
    body = {"tm": transverse, "lcc": conic}.get(p.method, cylinder)
    return lambda lon, lat: let(body, _turned(lon - p.lon0), isometric(lat, p.e))


def inverse(p: Projection) -> Change:
    """Coordinates of p -> (longitude, latitude) in radians."""
    k = p.k0 * (p.m(p.sp1) if p.sp1 else 1.0)
    rise = p.psi(p.lat0) if p.method == "merc" and p.sp1 is None else 0.0
    placed = lambda far, chi: let(lambda c: _xy(_turned(far + p.lon0), geodetic(c, p)), chi)

    def transverse(x: Column, y: Column) -> Column:
        size = p.k0 * p.rectifying
        waves = let(lambda a, b: F.struct(*[v.alias(n) for v, n in zip(_waves(a, b, INVERSE, p, -1), ("north", "east"), strict=True)]), y / size + _start(p), x / size)
        run = lambda w: F.sqrt(F.sinh(w.east) * F.sinh(w.east) + F.cos(w.north) * F.cos(w.north))
        return let(lambda w: placed(F.atan2(F.sinh(w.east), F.cos(w.north)), F.atan(F.sin(w.north) / run(w))), waves)

    def conic(x: Column, y: Column) -> Column:
        n, radius, origin = p.cone()
        side = 1.0 if n > 0 else -1.0
        down = F.lit(origin) - y
        psi = F.log(F.sqrt(x * x + down * down) / abs(radius)) / -n
        return placed(F.atan2(x * side, down * side) / n, F.atan(F.sinh(psi)))

    def cylinder(x: Column, y: Column) -> Column:
        return placed(x / (p.a * k), F.atan(F.sinh(y / (p.a * k) + rise)))

    if not p.method:
        return lambda x, y: _xy(x * p.angle, y * p.angle)
    body = {"tm": transverse, "lcc": conic}.get(p.method, cylinder)
    return lambda x, y: let(body, x * p.unit - p.fe, y * p.unit - p.fn)


#: Longitude and latitude in degrees.
DEGREES = Projection("", 6378137.0, 1 / 298.257223563)


def between(source: Projection, target: Projection) -> Change:
    """The change of (x, y) from one system to another."""
    back, there = inverse(source), forward(target)
    return lambda x, y: let(lambda g: there(g.x, g.y), back(x, y))
