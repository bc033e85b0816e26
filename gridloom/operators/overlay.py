"""Spatial joins as equi-joins on cell indices.

A regular grid has a closed form for which cells a box meets. Every geometry is dealt to the cells that its box meets
or touches, and joined to them on the index: no range join, and a hot cell is a hot key that adaptive execution splits.
Polygon layers meet each other through bins of a side in the order of their size; a pair that shares several bins is
kept in the first of them only, so nothing needs to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.kernels import overlap_area_udf


def _range(low: Column, high: Column, origin: float | Column, size: float | Column) -> Column:
    """Indices of cells that the interval meets or touches."""
    return F.sequence((F.ceil((low - origin) / size) - 1).cast("int"), F.floor((high - origin) / size).cast("int"))


def deal(layer: DataFrame, size: float, x: float = 0.0, y: float = 0.0, geometry: str = "geometry") -> DataFrame:
    """A row of the layer for every cell that its box meets: columns ix and iy are added."""
    b = F.col(geometry)["box"]
    rows = layer.withColumn("ix", F.explode(_range(b["x0"], b["x1"], x, size)))
    return rows.withColumn("iy", F.explode(_range(b["y0"], b["y1"], y, size)))


def grid_shape(grid: DataFrame) -> tuple[float, float, float]:
    """Cell size and the place of cell (0, 0)."""
    row = grid.agg(F.avg(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("s"), F.min(F.struct("ix", "x0")).alias("x"), F.min(F.struct("iy", "y0")).alias("y")).first()
    size = row["s"] or 1.0
    return (size, row["x"]["x0"] - row["x"]["ix"] * size, row["y"]["y0"] - row["y"]["iy"] * size) if row["x"] else (size, 0.0, 0.0)


def overlay(grid: DataFrame, layer: DataFrame, how: str = "left", shape: tuple[float, float, float] | None = None) -> DataFrame:
    """Cells with the features that meet or touch them.

    Returns geohash, ix, iy, cell (a box) and item (all of the layer's columns in a struct, so that no name clashes);
    with how="left" a cell without features has one row with a null item.
    """
    size, x, y = shape or grid_shape(grid)
    cells = grid.select("geohash", "ix", "iy", F.struct("x0", "y0", "x1", "y1").alias("cell"))
    items = deal(layer.select(F.struct(*[F.col(f"`{c}`") for c in layer.columns]).alias("item"), "geometry"), size, x, y)
    met = cells.join(items, ["ix", "iy"]).where(geo.intersects(F.col("geometry"), F.col("cell"))).drop("geometry")
    if how == "inner":
        return met.select("geohash", "ix", "iy", "cell", "item")
    # The exact test comes before the outer join, so that cells with near misses only are empty cells.
    matched = met.select("ix", "iy", "item")
    return cells.join(matched, ["ix", "iy"], "left").select("geohash", "ix", "iy", "cell", "item")


#: Aggregates of `summed`.
SUMS = {"sum": F.sum, "max": F.max, "count": lambda _: F.count(F.lit(1)).cast("double"), "one": lambda _: F.lit(1.0)}


def summed(grid: DataFrame, layer: DataFrame, sums: list[tuple[str, Column, str]]) -> DataFrame:
    """geohash, ix, iy and aggregates over the features that meet or touch each cell.

    sums: name, expression over item and cell (see `overlay`) and how it is aggregated (a key of SUMS). The aggregates
    are taken by cell index right after the overlay's join, so that each task adds up what it has and no geometry goes
    on. A cell without features has what the expressions give for a single null item.
    """
    size, x, y = grid_shape(grid)
    box = F.struct("x0", "y0", "x1", "y1").alias("cell")
    items = deal(layer.select(F.struct(*[F.col(f"`{c}`") for c in layer.columns]).alias("item"), "geometry"), size, x, y)
    met = grid.select("ix", "iy", box).join(items, ["ix", "iy"]).where(geo.intersects(F.col("geometry"), F.col("cell"))).drop("geometry")
    made = met.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_met"), *[SUMS[how](value).alias(name) for name, value, how in sums])
    none = F.lit(None).cast(items.schema["item"].dataType).alias("item")
    cells = grid.select("geohash", "ix", "iy", box, none).join(made, ["ix", "iy"], "left")
    alone = {"sum": lambda v: v, "max": lambda v: v, "count": lambda _: F.lit(1.0), "one": lambda _: F.lit(1.0)}
    return cells.select("geohash", "ix", "iy", *[F.when(F.col("_met").isNull(), alone[how](value)).otherwise(F.col(name)).alias(name) for name, value, how in sums])


def common_area(left: Column, right: Column) -> Column:
    """Area that two geometries share where at least one is a box."""
    return F.when(right["type"] == "Box", geo.area_within(left, right["box"])).when(left["type"] == "Box", geo.area_within(right, left["box"]))


def polygon_overlay(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of polygons that meet or touch: structs l and r, and their common area `part`.

    Bins have the mean size of the boxes of either layer. Pairs with a box are measured by expressions, others by the
    polygon kernel.
    """
    b = F.col("geometry")["box"]
    side = lambda d: d.agg(F.avg(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])).alias("s")).first()["s"] or 0.0
    size = max(side(left), side(right), 1e-9)

    def dealt(d: DataFrame, n: str) -> DataFrame:
        """The box as plain columns: conditions of the join then touch no nested fields."""
        rows = deal(d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias(n), "geometry"), size)
        return rows.select("ix", "iy", n, *[b[c].alias(f"_{n}{c}") for c in ("x0", "y0", "x1", "y1")])

    both = dealt(left, "l").join(dealt(right, "r"), ["ix", "iy"])
    a, c = F.col("l")["geometry"], F.col("r")["geometry"]
    index = lambda low: (F.ceil(low / size) - 1).cast("int")
    first = (F.col("ix") == F.greatest(index(F.col("_lx0")), index(F.col("_rx0")))) & (F.col("iy") == F.greatest(index(F.col("_ly0")), index(F.col("_ry0"))))
    touch = (F.col("_lx0") <= F.col("_rx1")) & (F.col("_rx0") <= F.col("_lx1")) & (F.col("_ly0") <= F.col("_ry1")) & (F.col("_ry0") <= F.col("_ly1"))
    both = both.where(first & touch).select("l", "r")
    plain = (a["type"] == "Box") | (c["type"] == "Box")
    kinds = {r["k"] for d in (left, right) for r in d.select((F.col("geometry")["type"] == "Box").alias("k")).distinct().collect()}
    if False in kinds:
        exact = both.where(~plain).withColumn("part", overlap_area_udf(geo.parts_of(a), geo.parts_of(c)))
        met = both.where(plain).withColumn("part", common_area(a, c)).where(F.col("part").isNotNull()).unionByName(exact)
    else:
        met = both.withColumn("part", geo.box_overlap(a["box"], c["box"]))
    if how == "inner":
        return met
    keys = [F.col(f"`{x}`") for x in left.columns]
    # Left rows without a partner, by a digest of their content.
    digest = lambda c: F.sha2(F.to_json(c), 256)
    alone = left.select(F.struct(*keys).alias("l")).withColumn("_t", digest("l"))
    missing = alone.join(met.select(digest("l").alias("_t")).distinct(), "_t", "left_anti")
    return met.unionByName(missing.select("l"), allowMissingColumns=True)
