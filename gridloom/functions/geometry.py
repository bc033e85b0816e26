"""Geometry as columns: a struct of nested coordinate arrays, with measures as Catalyst expressions.

A geometry is struct<type, srid, box, parts>. `box` is its bounding rectangle. `parts` is a list of polygons or lines,
each a list of rings or paths, each a list of points. Axis-parallel rectangles have type Box and no parts: all their
measures are closed forms on four numbers, inside whole-stage codegen.

Areas and lengths inside a cell need no intersection geometry: the area under each edge, clamped to the cell, is a
closed form, and the sum over a ring's edges is the ring's area in the cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PARTS = f"array<array<array<{POINT}>>>"
GEOMETRY = f"struct<type:string,srid:int,box:{BOX},parts:{PARTS}>"

#: 2 * sqrt(pi) and sqrt(pi) / 10, rounded as in the shape measures' definition (fixed values).
ROUND_PERIMETER, ROUND_TENTH = 3.5449077, 0.177245385


def _d(c: Column | float) -> Column:
    return c.cast("double") if isinstance(c, Column) else F.lit(float(c))


def _bounds(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(_d(x0).alias("x0"), _d(y0).alias("y0"), _d(x1).alias("x1"), _d(y1).alias("y1"))


def _geometry(kind: str | Column, box: Column, parts: Column, srid: int = 0) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), F.lit(srid).alias("srid"), box.alias("box"), parts.cast(PARTS).alias("parts"))


def box(x0: Column, y0: Column, x1: Column, y1: Column, srid: int = 0) -> Column:
    """An axis-parallel rectangle."""
    return _geometry("Box", _bounds(x0, y0, x1, y1), F.lit(None), srid)


def xy(x: Column, y: Column) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"))


def point(x: Column, y: Column, srid: int = 0) -> Column:
    return _geometry("Point", _bounds(x, y, x, y), F.lit(None), srid)


def from_parts(kind: str | Column, parts: Column, srid: int = 0) -> Column:
    """A geometry of nested points; its box is the least one around the first ring or path of each part."""
    flat = lambda c: F.flatten(F.transform(parts, lambda p: F.transform(p[0], lambda q: q[c])))
    return _geometry(kind, _bounds(F.array_min(flat("x")), F.array_min(flat("y")), F.array_max(flat("x")), F.array_max(flat("y"))), parts, srid)


def line(*points: tuple[Column, Column], srid: int = 0) -> Column:
    return from_parts("LineString", F.array(F.array(F.array(*[xy(x, y) for x, y in points]))), srid)


def polygon(*points: tuple[Column, Column], srid: int = 0) -> Column:
    """A polygon with one ring; the first point is repeated at its end."""
    return from_parts("Polygon", F.array(F.array(F.array(*[xy(x, y) for x, y in (*points, points[0])]))), srid)


def _clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)


def _edges(ring: Column) -> Column:
    """Pairs of points that follow one another."""
    n = F.size(ring)
    return F.when(n < 2, F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")).otherwise(F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(1))), F.slice(ring, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, i: s + of(i))


def _strip(e: Column, cell: Column) -> Column:
    """The signed area between an edge and the cell's lower side, inside the cell."""
    xa, ya, xb, yb = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
    x0, x1, y0, h = cell["x0"], cell["x1"], cell["y0"], cell["y1"] - cell["y0"]
    left, right = _clamp(xa, x0, x1), _clamp(xb, x0, x1)
    slope = F.try_divide(yb - ya, xb - xa)

    def under(t: Column) -> Column:
        u = t - y0
        return F.when(u <= 0, 0.0).when(u < h, u * u / 2).otherwise(h * h / 2 + h * (u - h))

    sloped = F.try_divide(under(ya + (right - xa) * slope) - under(ya + (left - xa) * slope), slope)
    return F.when(left == right, 0.0).when(ya == yb, (right - left) * _clamp(ya - y0, F.lit(0.0), h)).otherwise(sloped)


def _signed(ring: Column) -> Column:
    return _total(_edges(ring), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def _by_rings(parts: Column, of) -> Column:
    """Outer rings count, holes (all but the first) are taken off."""
    return _total(parts, lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("k")), lambda a, r: F.struct((a["s"] + a["k"] * F.abs(of(r))).alias("s"), F.lit(-1.0).alias("k")), lambda a: a["s"]))


def is_polygon(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def is_line(g: Column) -> Column:
    return g["type"].isin("LineString", "MultiLineString")


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def area(g: Column) -> Column:
    return F.when(g["type"] == "Box", box_area(g["box"])).when(is_polygon(g), _by_rings(g["parts"], _signed)).otherwise(0.0)


def _paths(parts: Column, of) -> Column:
    return _total(parts, lambda p: _total(p, lambda r: _total(_edges(r), of)))


def _norm(e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def length(g: Column) -> Column:
    """Length of a line; 0 for all else."""
    return F.when(is_line(g), _paths(g["parts"], _norm)).otherwise(0.0)


def perimeter(g: Column) -> Column:
    b = g["box"]
    return F.when(g["type"] == "Box", 2 * (b["x1"] - b["x0"] + b["y1"] - b["y0"])).when(is_polygon(g), _paths(g["parts"], _norm)).otherwise(0.0)


def box_overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    return w * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def boxes_touch(a: Column, b: Column) -> Column:
    """Whether two boxes share at least a point."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def area_within(g: Column, cell: Column) -> Column:
    """Area of the part of a geometry inside a cell (a box struct)."""
    ring = lambda r: _total(_edges(r), lambda e: _strip(e, cell))
    return F.when(g["type"] == "Box", box_overlap(g["box"], cell)).when(is_polygon(g), _by_rings(g["parts"], ring)).otherwise(0.0)


def _portion(e: Column, cell: Column) -> tuple[Column, Column]:
    """From which to which fraction of an edge it runs inside the cell."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for axis, low, high in (("x", "x0", "x1"), ("y", "y0", "y1")):
        at, d = e["a"][axis], e["b"][axis] - e["a"][axis]
        t, u = F.try_divide(cell[low] - at, d), F.try_divide(cell[high] - at, d)
        out = (d == 0) & ((at < cell[low]) | (at > cell[high]))
        lo = F.greatest(lo, F.when(out, 2.0).otherwise(F.coalesce(F.least(t, u), F.lit(0.0))))
        hi = F.least(hi, F.coalesce(F.greatest(t, u), F.lit(1.0)))
    return lo, hi


def length_within(g: Column, cell: Column) -> Column:
    """Length of the part of a line inside a cell."""

    def run(e: Column) -> Column:
        lo, hi = _portion(e, cell)
        return _norm(e) * F.greatest(hi - lo, F.lit(0.0))

    return F.when(is_line(g), _paths(g["parts"], run)).otherwise(0.0)


def intersects(g: Column, cell: Column) -> Column:
    """Whether a geometry and a cell share at least a point (touching counts)."""

    def meets(e: Column) -> Column:
        lo, hi = _portion(e, cell)
        return lo <= hi

    edge = F.exists(g["parts"], lambda p: F.exists(p, lambda r: F.exists(_edges(r), meets)))
    near = boxes_touch(g["box"], cell)
    return near & (g["type"].isin("Box", "Point") | F.coalesce(edge, F.lit(False)) | (is_polygon(g) & (area_within(g, cell) > 0)))


def outline(b: Column) -> Column:
    """A box's ring as points, counter-clockwise and closed."""
    p = [xy(b["x0"], b["y0"]), xy(b["x1"], b["y0"]), xy(b["x1"], b["y1"]), xy(b["x0"], b["y1"]), xy(b["x0"], b["y0"])]
    return F.array(*p)


def parts_of(g: Column) -> Column:
    """Nested points of any areal geometry; a box's outline."""
    return F.when(g["type"] == "Box", F.array(F.array(outline(g["box"])))).otherwise(g["parts"])


def snapped(g: Column, step: float = 0.001) -> Column:
    """The geometry with its coordinates rounded to multiples of `step`."""
    near = lambda v: F.round(v / step) * step
    b = g["box"]
    moved = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda q: xy(near(q["x"]), near(q["y"])))))
    return F.struct(g["type"].alias("type"), g["srid"].alias("srid"), _bounds(near(b["x0"]), near(b["y0"]), near(b["x1"]), near(b["y1"])).alias("box"), moved.alias("parts"))


def geometry_key(g: Column) -> Column:
    """A key of the geometry itself: equal geometries have equal keys."""
    b = g["box"]
    return F.md5(F.concat_ws("|", g["type"], b["x0"], b["y0"], b["x1"], b["y1"], F.coalesce(F.to_json(g["parts"]), F.lit(""))))
