"""Plane geometry as column functions over rings: array<struct<x, y>>, the first outer, others holes.

A ring is closed implicitly. Boundaries count as inside, touching as intersecting.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(ring((x1, y1), (x2, y1), (x2, y2), (x1, y2)))


def diamond(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return F.array(ring((mx, y1), (x2, my), (mx, y2), (x1, my)))


def ring_edges(r: Column) -> Column:
    """(x1, y1, x2, y2) of each side."""
    after = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def ring_area(r: Column) -> Column:
    """Positive for counter-clockwise rings."""
    return _sum(ring_edges(r), _cross) / 2


def area(rings: Column) -> Column:
    total = F.aggregate(F.transform(rings, lambda r: F.abs(ring_area(r))), F.lit(0.0), lambda s, a: s + a)
    return 2 * F.abs(ring_area(rings[0])) - total


def centroid(rings: Column) -> Column:
    """(x, y) by signed areas, holes taken off whatever their direction."""
    own = lambda c, other: F.aggregate(
        F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(ring_area(r)) * _sum(ring_edges(r), lambda e: (e[f"{c}1"] + e[f"{c}2"]) * _cross(e))), F.lit(0.0), lambda s, a: s + a
    )
    return F.struct((own("x", "y") / (6 * area(rings))).alias("x"), (own("y", "x") / (6 * area(rings))).alias("y"))


def bounds(rings: Column) -> Column:
    """Of all rings, as a shape of several parts has several outer ones."""
    corners = F.flatten(rings)
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def _on(e: Column, x: Column, y: Column) -> Column:
    side = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting, boundary included."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    count = F.size(F.filter(edges(rings), lambda e: F.coalesce(crosses(e), F.lit(False))))
    return (count % 2 == 1) | F.exists(edges(rings), lambda e: _on(e, x, y))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _touch(a: Column, b: Column) -> Column:
    d1, d2 = _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    d3, d4 = _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | _on(a, b["x1"], b["y1"]) | _on(a, b["x2"], b["y2"]) | _on(b, a["x1"], a["y1"]) | _on(b, a["x2"], a["y2"])


def intersects(a: Column, b: Column) -> Column:
    """Sides touch, or one holds the other."""
    meet = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: _touch(e, f)))
    return meet | contains_point(a, b[0][0]["x"], b[0][0]["y"]) | contains_point(b, a[0][0]["x"], a[0][0]["y"])


def within(a: Column, b: Column) -> Column:
    """All corners of a in b, and no side of a properly crosses one of b."""

    def crosses(e, f):
        d1, d2 = _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"]), _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
        d3, d4 = _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"]), _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
        return (d1 * d2 < 0) & (d3 * d4 < 0)

    return F.forall(a[0], lambda p: contains_point(b, p["x"], p["y"])) & ~F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: crosses(e, f)))


def distance_to(rings: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the nearest side."""

    def far(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt(F.pow(x - e["x1"] - t * dx, F.lit(2)) + F.pow(y - e["y1"] - t * dy, F.lit(2)))

    return F.when(contains_point(rings, x, y), 0.0).otherwise(F.array_min(F.transform(edges(rings), far)))


def _clip(r: Column, keep, at: float) -> Column:
    """Sutherland-Hodgman against the vertical line x = at."""
    def part(e):
        cut = F.struct(F.lit(at).alias("x"), (e["y1"] + (e["y2"] - e["y1"]) * (at - e["x1"]) / (e["x2"] - e["x1"])).alias("y"))
        end = F.struct(e["x2"].alias("x"), e["y2"].alias("y"))
        a, b = keep(e["x1"]), keep(e["x2"])
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(a & b, F.array(end)).when(a & ~b, F.array(cut)).when(~a & b, F.array(cut, end)).otherwise(none)

    return F.flatten(F.transform(ring_edges(r), part))


def split_antimeridian(outer: Column) -> Column:
    """Rings of longitudes up to 540: the part up to 180 and the part beyond, moved back by 360; empty parts drop out."""
    west = _clip(outer, lambda v: v <= 180, 180.0)
    east = F.transform(_clip(outer, lambda v: v >= 180, 180.0), lambda p: F.struct((p["x"] - 360).alias("x"), p["y"].alias("y")))
    return F.filter(F.array(west, east), lambda r: (F.size(r) >= 3) & (F.abs(ring_area(r)) > 0))


#: WGS84 (fixed values).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def laea(lon: Column, lat: Column, lon0: Column | float, lat0: Column | float) -> Column:
    """Lambert azimuthal equal-area (x, y) in metres, ellipsoidal form."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * F.ln((1 - e * s) / (1 + e * s)))
    lon, lat, lon0, lat0 = (F.radians(v if isinstance(v, Column) else F.lit(float(v))) for v in (lon, lat, lon0, lat0))
    qp = q(F.lit(1.0))
    b, b0 = F.asin(q(F.sin(lat)) / qp), F.asin(q(F.sin(lat0)) / qp)
    rq = SEMI_MAJOR * F.sqrt(qp / 2)
    m0 = F.cos(lat0) / F.sqrt(1 - e2 * F.pow(F.sin(lat0), F.lit(2)))
    d = SEMI_MAJOR * m0 / (rq * F.cos(b0))
    bb = rq * F.sqrt(2 / (1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(lon - lon0)))
    x = bb * d * F.cos(b) * F.sin(lon - lon0)
    y = bb / d * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(lon - lon0))
    return F.struct(x.alias("x"), y.alias("y"))


def lcc(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float) -> Column:
    """Lambert conformal conic (x, y) in metres with two standard parallels."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    rho0 = SEMI_MAJOR * f * t(p0) ** n
    p = F.radians(lat)
    tt = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho = SEMI_MAJOR * f * F.pow(tt, F.lit(n))
    theta = n * F.radians(lon - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _steps(start: Column, f, count: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, lambda v, _: f(v))


def laea_inverse(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """(lon, lat) in degrees of equal-area coordinates: the authalic latitude exactly, the geodetic one by three Newton steps."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    qn = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))
    p0, qp = math.radians(lat0), qn(1.0)
    b0 = math.asin(qn(math.sin(p0)) / qp)
    rq = SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(p0) / math.sqrt(1 - e2 * math.sin(p0) ** 2) / (rq * math.cos(b0))
    step = lambda q: lambda p: p + F.pow(1 - e2 * F.pow(F.sin(p), F.lit(2)), F.lit(2)) / (2 * F.cos(p)) * (
        q / (1 - e2) - F.sin(p) / (1 - e2 * F.pow(F.sin(p), F.lit(2))) + 1 / (2 * e) * F.ln((1 - e * F.sin(p)) / (1 + e * F.sin(p)))
    )
    pole = math.pi / 2 - 1e-9

    def latitude(sin_b: Column) -> Column:
        b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_b)))
        return _bound(b, lambda b: F.when(F.abs(b) > pole, b).otherwise(_steps(b + e2 / 3 * F.sin(2 * b), step(qp * F.sin(b)), 3)))

    def of(r: Column) -> Column:
        ce = 2 * F.asin(F.least(F.lit(1.0), r / (2 * rq)))
        sin_b = F.when(r == 0, math.sin(b0)).otherwise(F.cos(ce) * math.sin(b0) + d * y * F.sin(ce) * math.cos(b0) / F.when(r == 0, 1.0).otherwise(r))
        lon = F.atan2(x * F.sin(ce), d * r * math.cos(b0) * F.cos(ce) - d * d * y * math.sin(b0) * F.sin(ce))
        return F.struct((F.lit(float(lon0)) + F.when(r == 0, 0.0).otherwise(F.degrees(lon))).alias("lon"), F.degrees(latitude(sin_b)).alias("lat"))

    return _bound(F.sqrt(F.pow(x / d, F.lit(2)) + F.pow(y * d, F.lit(2))), of)


def lcc_inverse(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float) -> Column:
    """(lon, lat) in degrees of conformal conic coordinates, the latitude by eight fixed-point steps."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = SEMI_MAJOR * m(p1) / (n * t(p1) ** n)
    rho0, sign = f * t(p0) ** n, math.copysign(1.0, n)
    rho = F.sqrt(F.pow(x, F.lit(2)) + F.pow(rho0 - y, F.lit(2)))
    step = lambda t: lambda p: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
    lat = _bound(F.pow(rho / abs(f), F.lit(1 / n)), lambda t: _steps(math.pi / 2 - 2 * F.atan(t), step(t), 8))
    return F.struct((F.degrees(F.atan2(sign * x, sign * (rho0 - y))) / n + lon0).alias("lon"), F.degrees(lat).alias("lat"))


def reprojected(rings: Column, to: Callable[[Column, Column], Column]) -> Column:
    """Rings with every corner moved by to(x, y), a struct of x and y."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: _bound(to(p["x"], p["y"]), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))))


def between(inverse: Callable[[Column, Column], Column], forward: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """From one projection's (x, y) through degrees to another's."""
    return lambda x, y: _bound(inverse(x, y), lambda p: forward(p["lon"], p["lat"]))
