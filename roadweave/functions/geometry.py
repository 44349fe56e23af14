"""Planar geometry on polylines, ``array<struct<x: double, y: double>>``, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def segments(line: Column) -> Column:
    """(a, b, length) of the line's segments."""
    return F.transform(
        F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))),
        lambda a, i: _bind(F.get(line, i + 1), lambda b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b.x - a.x, b.y - a.y).alias("length"))),
    )


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda n, s: n + s.length)


def azimuth(line: Column) -> Column:
    """Degrees clockwise from north, from the first to the last point."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    return F.pmod(F.degrees(F.atan2(b.x - a.x, b.y - a.y)), F.lit(360.0))


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at a share of the line's length."""
    names = lambda left, at, done: F.struct(left.cast("double").alias("left"), at.alias("at"), done.alias("done"))

    def step(acc: Column, s: Column) -> Column:
        share = F.when(s.length > 0, F.least(acc.left / s.length, F.lit(1.0))).otherwise(F.lit(0.0))
        point = F.struct((s.a.x + (s.b.x - s.a.x) * share).alias("x"), (s.a.y + (s.b.y - s.a.y) * share).alias("y"))
        return F.when(acc.done, acc).otherwise(names(acc.left - s.length, point, acc.left <= s.length))

    first = F.element_at(line, 1)
    return F.aggregate(segments(line), names(fraction * length(line), F.struct(first.x.cast("double").alias("x"), first.y.cast("double").alias("y")), F.lit(False)), step, lambda acc: acc.at)


def distance_to_point(line: Column, x: Column, y: Column) -> Column:
    """Least distance from a point to the line's segments."""

    def one(s: Column) -> Column:
        dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s.a.x) * dx + (y - s.a.y) * dy) / square))).otherwise(0.0)
        return F.hypot(x - s.a.x - t * dx, y - s.a.y - t * dy)

    return F.array_min(F.transform(segments(line), one))


def envelope(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def sample(line: Column, n: int) -> Column:
    """n + 1 points at even shares of the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: interpolate(line, i / F.lit(float(n))))


# --- positions along lines ---------------------------------------------------------------------
def located(line: Column, x: Column, y: Column) -> Column:
    """(distance, along, x, y) of the line's point nearest to a point; the first of equally near."""
    segs = F.transform(segments(line), lambda s: s)

    def one(s: Column, before: Column) -> Column:
        dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s.a.x) * dx + (y - s.a.y) * dy) / square))).otherwise(F.lit(0.0))
        return _bind(t, lambda t: F.struct(F.hypot(x - s.a.x - t * dx, y - s.a.y - t * dy).alias("distance"), (before + t * s.length).alias("along"), (s.a.x + t * dx).alias("x"), (s.a.y + t * dy).alias("y")))

    def step(acc: Column, s: Column) -> Column:
        new = one(s, acc.before)
        return F.struct((acc.before + s.length).alias("before"), F.when(acc.best.isNull() | (new.distance < acc.best.distance), new).otherwise(acc.best).alias("best"))

    kind = "struct<before:double,best:struct<distance:double,along:double,x:double,y:double>>"
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("struct<distance:double,along:double,x:double,y:double>").alias("best")).cast(kind)
    return F.aggregate(segs, start, lambda a, s: step(a, s).cast(kind), lambda a: a.best)


def substring(line: Column, low: Column, high: Column) -> Column:
    """The part of a line between two shares of its length."""

    def whole(n: Column) -> Column:
        ends = F.transform(segments(line), lambda s: s.length)
        upto = F.transform(line, lambda p, i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0.0), lambda a, v: a + v))
        inner = F.filter(F.transform(line, lambda p, i: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"), F.get(upto, i).alias("at"))), lambda p: (p["at"] > low * n + 1e-9) & (p["at"] < high * n - 1e-9))
        return F.concat(F.array(interpolate(line, low)), F.transform(inner, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))), F.array(interpolate(line, high)))

    return _bind(length(line), whole)


def distance_to_line(a: Column, b: Column) -> Column:
    """Least distance between two lines: zero where segments cross, else from an end to a segment."""

    def pair(s: Column, t: Column) -> Column:
        cross = lambda p, q, r: (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)
        apart = (cross(s.a, s.b, t.a) * cross(s.a, s.b, t.b) < 0) & (cross(t.a, t.b, s.a) * cross(t.a, t.b, s.b) < 0)
        two = lambda u: F.array(u.a, u.b)
        ends = F.least(*(distance_to_point(two(u), p.x, p.y) for u, v in ((s, t), (t, s)) for p in (v.a, v.b)))
        return F.when(apart, 0.0).otherwise(ends)

    return F.array_min(F.flatten(F.transform(segments(a), lambda s: F.transform(segments(b), lambda t: pair(s, t)))))


def local_bearing(line: Column, along: Column, window: float = 10.0) -> Column:
    """Degrees from east, counted against the clock, over a short window around a place."""

    def over(n: Column) -> Column:
        p = interpolate(line, F.greatest(F.lit(0.0), along - window) / n)
        q = interpolate(line, F.least(n, along + window) / n)
        return _bind(p, lambda p: _bind(q, lambda q: F.degrees(F.atan2(q.y - p.y, q.x - p.x))))

    return _bind(length(line), over)


def fold90(degrees: Column) -> Column:
    """An angle between two lines without direction, from 0 to 90."""
    half = F.pmod(degrees, F.lit(180.0))
    return F.when(half > 90, 180.0 - half).otherwise(half)


def set_point(line: Column, i: Column | int, x: Column, y: Column) -> Column:
    """The line with one vertex (from 0) put elsewhere."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.transform(line, lambda p, k: F.when(k == i, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).otherwise(F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))))


def midpoint(line: Column) -> Column:
    """The point half way: what stands for a line's centroid, and lies on it."""
    return interpolate(line, F.lit(0.5))


# --- map projections ---------------------------------------------------------------------------
#: The transverse Mercator grid in use and its ellipsoid (fixed values): axis, flattening, central
#: meridian, scale on it, false easting and northing.
A, FLATTENING, MERIDIAN, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257222101, 173.0, 0.9996, 1_600_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the third flattening to the fourth order, forward and back.
_FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_ECC = (FLATTENING * (2 - FLATTENING)) ** 0.5


def to_grid(lon: Column, lat: Column) -> Column:
    """Degrees to grid metres, by the series in the third flattening."""
    lam, phi = F.radians(lon - MERIDIAN), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))

    def both(xi: Column, eta: Column) -> Column:
        north, east = xi, eta
        for j, c in enumerate(_FORTH, 1):
            north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct((EAST + SCALE * _RADIUS * east).alias("x"), (NORTH + SCALE * _RADIUS * north).alias("y"))

    return _bind(F.struct(xi.alias("a"), eta.alias("b")), lambda v: both(v.a, v.b))


def to_degrees(x: Column, y: Column) -> Column:
    """Grid metres to degrees."""
    xi, eta = (y - NORTH) / (SCALE * _RADIUS), (x - EAST) / (SCALE * _RADIUS)

    def both(xi: Column, eta: Column) -> Column:
        north, east = xi, eta
        for j, c in enumerate(_BACK, 1):
            north = north - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return _bind(F.struct(north.alias("n"), east.alias("e")), lambda v: _latitude(v.n, v.e))

    return _bind(F.struct(xi.alias("a"), eta.alias("b")), lambda v: both(v.a, v.b))


def _latitude(north: Column, east: Column) -> Column:
    conformal = F.asin(F.sin(north) / F.cosh(east))
    lon = MERIDIAN + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    # geographic latitude from the conformal one, by fixed-point steps that shrink by e squared each
    goal = F.atanh(F.sin(conformal))
    start = F.struct(F.sin(conformal).alias("s"), goal.alias("g"))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda a, _: F.struct(F.tanh(a.g + _ECC * F.atanh(_ECC * a.s)).alias("s"), a.g.alias("g")), lambda a: a.s)
    return F.struct(lon.alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """Web-Mercator metres of a map tile."""
    half = 20037508.342789244
    size = F.lit(2 * half) / F.pow(F.lit(2.0), z)
    return F.struct((x * size - half).alias("minx"), (half - (y + 1) * size).alias("miny"), ((x + 1) * size - half).alias("maxx"), (half - y * size).alias("maxy"))
