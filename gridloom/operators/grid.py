"""Study area and analysis grid."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kernels, project
from ..functions.geohash import cell_key

#: Default cell size, in units of the reference system.
CELL = 100.0


def bounds(layer: DataFrame) -> DataFrame:
    """One row with the bounding box of a layer: x0, y0, x1, y1."""
    b = F.col("geometry")["box"]
    return layer.agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def extent(layer: DataFrame) -> DataFrame:
    """One row: the union of a layer's polygons, as `geometry`, with its box x0, y0, x1, y1.

    Polygons that overlap at most along shared edges (a tiling) become one multipolygon. It grows with the outline and
    not with the rows: pieces are merged per partition first, and the results again.
    """

    def merge(batches):
        parts = [kernels.rings(p) for batch in batches for p in batch["parts"] if p is not None]
        yield pd.DataFrame({"parts": [kernels.as_points(kernels.union_tiles(parts))]})

    pieces = layer.select(geo.parts_of(F.col("geometry")).alias("parts"))
    merged = pieces.mapInPandas(merge, f"parts {geo.PARTS}").repartition(1).mapInPandas(merge, f"parts {geo.PARTS}")
    return merged.select(geo.from_parts("MultiPolygon", F.col("parts")).alias("geometry")).select("geometry", "geometry.box.*")


def make_grid(area: tuple[float, float, float, float], size: float = CELL, xoffset: float = 0.0, yoffset: float = 0.0, drop_touching: bool = False, *, spark, inside: Column | None = None, lonlat: Callable[[Column, Column], tuple[Column, Column]] | None = None, srid: int = 0) -> DataFrame:
    """Square cells over a box: ix, iy, x0, y0, x1, y1, inside, geohash.

    The series of cells includes the one that begins at the box's far edge, and cells that only touch the box stay
    (unless `drop_touching`). inside: whether the whole cell lies in the area (default: in the box). geohash is the
    reversed geohash of the cell's centre; lonlat or srid tells how to find that on the globe, without either the plane
    is taken for degrees around its origin.
    """
    x0, y0, x1, y1 = map(float, area)
    low_index = lambda v, off: (v - off) // size
    many = lambda a, b, off: int(-(-(b - off) // size) - low_index(a, off))
    first_x, first_y = low_index(x0, xoffset) * size + xoffset, low_index(y0, yoffset) * size + yoffset
    cells = spark.range(many(x0, x1, xoffset) + 1).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(0), F.lit(many(y0, y1, yoffset)))).alias("iy"))
    left, low = F.col("ix") * size + first_x, F.col("iy") * size + first_y
    cells = cells.select("ix", "iy", left.alias("x0"), low.alias("y0"), (left + size).alias("x1"), (low + size).alias("y1"))
    touch = (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)
    cells = cells.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0) if drop_touching else touch)
    whole = (F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("y0") >= y0) & (F.col("y1") <= y1)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    if lonlat:
        lon, lat = lonlat(cx, cy)
    else:
        lon, lat = project.to_degrees(cx, cy, srid) if srid else (cx / 111320.0, cy / 111320.0)
    return cells.withColumn("inside", whole if inside is None else inside).withColumn("geohash", cell_key(lon, lat))


def inside_extent(area: DataFrame) -> Column:
    """Whether a cell lies wholly in the polygon of a one-row extent: their common area is the cell's."""
    shape = area.select("geometry").first()["geometry"]
    parts = F.lit(None) if shape["parts"] is None else F.array(*[F.array(*[F.array(*[geo.xy(F.lit(q["x"]), F.lit(q["y"])) for q in r]) for r in p]) for p in shape["parts"]])
    whole = geo.from_parts("MultiPolygon", parts)
    cell = F.struct("x0", "y0", "x1", "y1")
    return F.abs(geo.area_within(whole, cell) - geo.box_area(cell)) < 1e-9 * geo.box_area(cell)


def clip(layer: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose bounding box meets the area's."""
    x0, y0, x1, y1 = area
    b = F.col("geometry")["box"]
    return layer.where((b["x0"] <= x1) & (b["x1"] >= x0) & (b["y0"] <= y1) & (b["y1"] >= y0))


def within_index(cells: DataFrame, size: float, xoffset: float = 0.0, yoffset: float = 0.0) -> DataFrame:
    """Add cx, cy: the coarse cell of side `size` in which a cell lies wholly, null if it lies across an edge."""
    index = lambda v, off: F.floor((F.col(v) - off) / size + 1e-9)
    far = lambda v, off: F.ceil((F.col(v) - off) / size - 1e-9) - 1
    cx, cy = index("x0", xoffset), index("y0", yoffset)
    fits = (far("x1", xoffset) <= cx) & (far("y1", yoffset) <= cy)
    return cells.withColumns({"cx": F.when(fits, cx), "cy": F.when(fits, cy)})
