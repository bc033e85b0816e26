"""Layers put right: categories translated, shapes measured, geometries repaired and dissolved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kernels
from ..functions.translate import Translation
from ..runtime import durable


def recategorise(layer: DataFrame, source: str, target: str, translation: Translation) -> DataFrame:
    """The layer with a column `target`: `source` through a translation."""
    return layer.withColumn(target, translation.column(F.col(source)))


def shape_metrics(layer: DataFrame, geometry: str = "geometry", buffers: bool = True) -> DataFrame:
    """The layer with area and the perimeter, fullness, depth, concavity and detour indices of its polygons.

    Each compares with a circle of the same area or with the convex hull. The closed forms are expressions; hull and
    buffer need the kernels and run only for what is not a box where there is a closed form for boxes.
    """
    g = F.col(geometry)
    a, p = geo.area(g), geo.perimeter(g)
    parts = geo.parts_of(g)
    hull = kernels.hull_udf(parts)
    out = layer.withColumn("area", a).withColumn("perim_index", F.try_divide(p, geo.ROUND_PERIMETER * F.sqrt(a)))
    if buffers:
        # A row takes the kernels far longer than the scan: what one scan task reads is dealt to all.
        out = out.repartition(int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        out = out.withColumn("_buffers", kernels.buffered_areas_udf(parts, geo.ROUND_TENTH * F.sqrt(a)))
        out = out.withColumn("fullness_index", F.try_divide(F.col("_buffers.grown"), a)).withColumn("depth_index", F.try_divide(F.col("_buffers.shrunk"), a)).drop("_buffers")
    out = out.withColumn("_hull", hull)
    out = out.withColumn("concavity_index", 1 - F.try_divide(F.col("area"), F.col("_hull.area")))
    return out.withColumn("detour_index", F.try_divide(geo.ROUND_PERIMETER * F.sqrt("area"), F.col("_hull.perimeter"))).drop("_hull")


def fix_geometries(layer: DataFrame) -> DataFrame:
    """Polygons made valid: rings closed and turned the right way, spikes and empty rings taken out. Boxes are valid."""
    g = F.col("geometry")
    fixed = geo.from_parts(g["type"], kernels.repair_udf(g["parts"]))
    return layer.withColumn("geometry", F.when(geo.is_polygon(g), fixed).otherwise(g))


def _corners(g: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(geo.parts_of(g))))


def touching(layer: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of polygons of a tiling that share an edge or a corner point on their boxes' border."""
    from .overlay import polygon_overlay

    pairs = polygon_overlay(layer.select(key, "geometry"), layer.select(key, "geometry"))
    return pairs.where(F.col("l")[key] < F.col("r")[key]).select(F.col("l")[key].alias("a"), F.col("r")[key].alias("b"), F.col("l")["geometry"].alias("ga"), F.col("r")["geometry"].alias("gb"), "part")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Labels spread along edges and jump to their label's label."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(nodes.select(F.col("id"), F.col("id").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("_old"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        new = durable(step.join(up, "component").select("id", F.least("component", "_up").alias("component"), "_old"))
        labels = new.select("id", "component")
        if new.where("component <> _old").isEmpty():
            return labels


def dissolve(layer: DataFrame, key: str) -> DataFrame:
    """Connected parts of a tiling: component (smallest key) and geometry; attributes go.

    Polygons that share an edge are one part. Each part is merged on its own, so the work is bounded by the largest part.
    """
    edge = touching(layer, key)
    a, b = F.col("ga")["box"], F.col("gb")["box"]
    # A shared border of some length: boxes that touch in more than a point; others by their common corner points.
    length = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    boxes = (F.col("ga")["type"] == "Box") & (F.col("gb")["type"] == "Box")
    shared = F.when(boxes, length > 0).otherwise((F.col("part") > 0) | (F.size(F.array_intersect(_corners(F.col("ga")), _corners(F.col("gb")))) > 1))
    labels = connected(edge.where(shared), layer.select(F.col(key).alias("id")))
    pieces = layer.select(F.col(key).alias("id"), geo.parts_of(F.col("geometry")).alias("parts")).join(labels, "id")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        made = kernels.union_tiles([kernels.rings(p) for p in rows["parts"]])
        return pd.DataFrame({"component": [rows["component"].iloc[0]], "parts": [kernels.as_points(made)]})

    kind = layer.schema[key].dataType.simpleString()
    made = pieces.groupBy("component").applyInPandas(merge, f"component {kind}, parts {geo.PARTS}")
    return made.select("component", geo.from_parts("MultiPolygon", F.col("parts")).alias("geometry"))
