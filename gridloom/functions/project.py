"""Map projections as column arithmetic: WGS 84 degrees, Web Mercator, UTM and the European equal-area grid."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius and flattening of the WGS 84 and GRS 80 ellipsoids (fixed values).
RADIUS, FLAT_WGS, FLAT_GRS = 6378137.0, 1 / 298.257223563, 1 / 298.257222101


class UnknownProjection(ValueError):
    """A reference system that has no formula here."""


def _bound(body: Callable[[Column], Column], **values: Column) -> Column:
    """`body` over a struct of `values`, each of which is computed once and stands in the plan once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _place(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _mercator(lon: Column, lat: Column) -> Column:
    return _place(F.radians(lon) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS)


def _from_mercator(x: Column, y: Column) -> Column:
    return _place(F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2))


def _series(e2: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius factor and the series of the transverse Mercator projection (third flattening, 4 terms)."""
    f = 1 - math.sqrt(1 - e2)
    n = f / (2 - f)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, ahead, back


def _utm(lon: Column, lat: Column, zone: int, south: bool) -> Column:
    e2 = FLAT_WGS * (2 - FLAT_WGS)
    e = math.sqrt(e2)
    radius, ahead, _ = _series(e2)
    k = 0.9996 * RADIUS * radius

    def sums(v: Column) -> Column:
        x, y = v["eta"], v["xi"]
        for j, a in enumerate(ahead, 1):
            x = x + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            y = y + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return _place(500000 + k * x, (10000000.0 if south else 0.0) + k * y)

    conformal = lambda v: _bound(lambda u: _bound(sums, xi=F.atan2(u["t"], F.cos(u["d"])), eta=F.atanh(F.sin(u["d"]) / F.sqrt(1 + u["t"] * u["t"]))), t=F.sinh(F.atanh(v["s"]) - e * F.atanh(e * v["s"])), d=v["d"])
    return _bound(conformal, s=F.sin(F.radians(lat)), d=F.radians(lon - (6 * zone - 183)))


def _from_utm(x: Column, y: Column, zone: int, south: bool) -> Column:
    e2 = FLAT_WGS * (2 - FLAT_WGS)
    radius, _, back = _series(e2)
    k = 0.9996 * RADIUS * radius

    def sums(v: Column) -> Column:
        a, b = v["xi"], v["eta"]
        for j, c in enumerate(back, 1):
            a = a - c * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            b = b - c * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return _bound(ends, a=a, b=b)

    def ends(v: Column) -> Column:
        lat = _bound(lambda u: _latitude(u["chi"], e2), chi=F.asin(F.sin(v["a"]) / F.cosh(v["b"])))
        return _place(F.degrees(F.atan2(F.sinh(v["b"]), F.cos(v["a"]))) + (6 * zone - 183), F.degrees(lat))

    return _bound(sums, xi=(y - (10000000.0 if south else 0.0)) / k, eta=(x - 500000) / k)


def _latitude(conformal: Column, e2: float) -> Column:
    """Geographic from conformal latitude, by its series."""
    c = [e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12, 7 * e2**2 / 48 + 29 * e2**3 / 240, 7 * e2**3 / 120]
    return conformal + sum((k * F.sin(2 * (i + 1) * conformal) for i, k in enumerate(c)), F.lit(0.0))


def _equal_area() -> tuple[float, float, Callable, float, float, float, float]:
    """e2, e, the authalic function, its value at the pole, the authalic latitude of 52 degrees, and the two scales."""
    e2 = FLAT_GRS * (2 - FLAT_GRS)
    e = math.sqrt(e2)

    def q(s):
        log = F.log if isinstance(s, Column) else math.log
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    top, s0 = q(1.0), math.sin(math.radians(52))
    b0 = math.asin(q(s0) / top)
    rq = RADIUS * math.sqrt(top / 2)
    d = RADIUS * math.cos(math.radians(52)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    return e2, e, q, top, b0, rq, d


def _laea(lon: Column, lat: Column) -> Column:
    _, _, q, top, b0, rq, d = _equal_area()

    def out(v: Column) -> Column:
        k, b, turn = v["k"], v["b"], v["turn"]
        return _place(4321000 + k * d * F.cos(b) * F.sin(turn), 3210000 + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(turn)))

    scale = lambda v: rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(v["b"]) + math.cos(b0) * F.cos(v["b"]) * F.cos(v["turn"])))
    scaled = lambda v: _bound(out, k=scale(v), b=v["b"], turn=v["turn"])
    return _bound(lambda u: _bound(scaled, b=F.asin(q(u["s"]) / top), turn=u["turn"]), s=F.sin(F.radians(lat)), turn=F.radians(lon - 10))


def _from_laea(x: Column, y: Column) -> Column:
    e2, _, _, _, b0, rq, d = _equal_area()
    k = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]

    def out(v: Column) -> Column:
        lon = 10 + F.degrees(F.atan2(v["u"] * v["s"], v["rho"] * math.cos(b0) * v["c"] - v["v"] * math.sin(b0) * v["s"]))
        return _place(lon, F.degrees(v["b"] + sum((a * F.sin(2 * (i + 1) * v["b"]) for i, a in enumerate(k)), F.lit(0.0))))

    def turned(v: Column) -> Column:
        b = F.asin(F.cos(v["c"]) * math.sin(b0) + v["v"] * F.sin(v["c"]) * math.cos(b0) / v["rho"])
        return _bound(out, u=v["u"], v=v["v"], rho=v["rho"], s=F.sin(v["c"]), c=F.cos(v["c"]), b=b)

    far = lambda v: F.greatest(F.sqrt(v["u"] * v["u"] + v["v"] * v["v"]), F.lit(1e-9))
    angle = lambda v: _bound(turned, u=v["u"], v=v["v"], rho=v["rho"], c=2 * F.asin(v["rho"] / (2 * rq)))
    return _bound(lambda v: _bound(angle, u=v["u"], v=v["v"], rho=far(v)), u=(x - 4321000) / d, v=(y - 3210000) * d)


def _to_degrees(x: Column, y: Column, srid: int) -> Column:
    if srid == 4326:
        return _place(x, y)
    if srid == 3857:
        return _from_mercator(x, y)
    if srid == 3035:
        return _from_laea(x, y)
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return _from_utm(x, y, srid % 100, srid > 32700)
    raise UnknownProjection(f"no formula for EPSG:{srid}")


def _from_degrees(lon: Column, lat: Column, srid: int) -> Column:
    if srid == 4326:
        return _place(lon, lat)
    if srid == 3857:
        return _mercator(lon, lat)
    if srid == 3035:
        return _laea(lon, lat)
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return _utm(lon, lat, srid % 100, srid > 32700)
    raise UnknownProjection(f"no formula for EPSG:{srid}")


def moved(x: Column, y: Column, source: int, target: int) -> Column:
    """A struct (x, y): the place in the reference system `target` (EPSG).

    Steps are bound one after the other, so that the expression grows with their number only.
    """
    if source == target:
        return _place(x, y)
    _from_degrees(F.lit(0.0), F.lit(0.0), target)  # an unknown system is an error at once
    degrees = lambda v: _bound(lambda p: _from_degrees(p["q"]["x"], p["q"]["y"], target), q=_to_degrees(v["x"], v["y"], source))
    return _bound(degrees, x=x, y=y)


def to_degrees(x: Column, y: Column, srid: int) -> tuple[Column, Column]:
    """Longitude and latitude of a place in the reference system `srid` (EPSG)."""
    made = _to_degrees(x, y, srid)
    return made["x"], made["y"]


def from_degrees(lon: Column, lat: Column, srid: int) -> tuple[Column, Column]:
    made = _from_degrees(lon, lat, srid)
    return made["x"], made["y"]


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    made = moved(x, y, source, target)
    return made["x"], made["y"]


def transform_geometry(g: Column, source: int, target: int) -> Column:
    """A geometry in another reference system; a box becomes the polygon of its corners."""
    from . import geometry as geo

    if source == target:
        return g
    again = lambda p: _bound(lambda v: geo.xy(v["p"]["x"], v["p"]["y"]), p=p)
    parts = F.transform(geo.parts_of(g), lambda p: F.transform(p, lambda r: F.transform(r, lambda q: again(moved(q["x"], q["y"], source, target)))))
    kind = F.when(g["type"] == "Box", F.lit("Polygon")).otherwise(g["type"])
    point = _bound(lambda v: geo.point(v["p"]["x"], v["p"]["y"], target), p=moved(g["box"]["x0"], g["box"]["y0"], source, target))
    return F.when(g["type"] == "Point", point).otherwise(geo.from_parts(kind, parts, target))
