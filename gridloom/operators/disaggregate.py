"""Known totals of areas spread over a grid or over other polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from .overlay import overlay, polygon_overlay


def _absolute_only(relative: bool) -> None:
    if relative:
        raise NotImplementedError("relative values can't be disaggregated")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _parts(grid: DataFrame, sources: DataFrame, field: str, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Cells met by source polygons, with the common area and the cell's weights; sources go by their geometry."""
    named = sources.select("geometry", F.col(field).cast("double").alias("value"), geo.geometry_key(F.col("geometry")).alias("source"))
    met = overlay(grid, named, "inner")
    met = met.select("geohash", "ix", "iy", F.col("item.source").alias("source"), F.col("item.value").alias("value"), geo.area_within(F.col("item.geometry"), F.col("cell")).alias("part"))
    return met.join(weights.select("geohash", *columns), "geohash", "left")


def disaggregate(grid: DataFrame, sources: DataFrame, field: str, weights: DataFrame, weight: str = "weight", relative: bool = False) -> DataFrame:
    """geohash, ix, iy, value: each source's total by weight times common area.

    A source whose weights are all 0 or missing gives nothing. Cells that only touch a source get 0.
    """
    _absolute_only(relative)
    parts = _parts(grid, sources, field, weights, [weight]).withColumn("w", _or_zero(F.col(weight) * F.col("part")))
    totals = parts.groupBy("source").agg(F.sum("w").alias("total"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("value") * F.col("w") / F.nullif(F.col("total"), F.lit(0.0)))
    return parts.join(totals, "source").groupBy("geohash", "ix", "iy").agg(F.sum(share).alias("value"))


def disaggregate_batch(grid: DataFrame, sources: DataFrame, field: str, weights: DataFrame, columns: list[str] | None = None, relative: bool = False) -> DataFrame:
    """geohash, ix, iy and a column for each weight column, from one overlay.

    A cell's weight is dealt to sources by their share of the cell's covered area. A source without weight is spread by
    area instead, so no total is lost. Only cells with a common area come out.
    """
    _absolute_only(relative)
    columns = columns or [c for c in weights.columns if c not in ("geohash", "ix", "iy")]
    parts = _parts(grid, sources, field, weights, columns).where("part > 0")
    covered = F.sum("part").over(Window.partitionBy("geohash"))
    dealt = parts.withColumn("_covered", covered).select("geohash", "ix", "iy", "source", "value", "part", *[(_or_zero(F.col(c)) * F.col("part") / F.col("_covered")).alias(c) for c in columns])
    totals = dealt.groupBy("source").agg(F.sum("part").alias("_area"), F.max("value").alias("_value"), *[F.sum(c).alias(f"_{c}") for c in columns])
    out = []
    for c in columns:
        by_weight = F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))
        out.append(F.sum(F.col("_value") * F.when(F.col(f"_{c}") == 0, F.col("part") / F.col("_area")).otherwise(by_weight)).alias(c))
    return dealt.drop("value").join(totals, "source").groupBy("geohash", "ix", "iy").agg(*out)


def disaggregate_raw(sources: DataFrame, fields: list[str], targets: DataFrame, weights: list[str], keep_unweighted: bool = False, relative: bool = False) -> DataFrame:
    """Totals of source polygons over target polygons: <field>_disag_<weight> for each pair, with the targets' columns.

    A target's weight is dealt to sources by their share of its covered area. With keep_unweighted a source that meets no
    target comes out itself, with its own geometry. A source with weights of 0 gives nothing.
    """
    _absolute_only(relative)
    left = sources.select("geometry", *dict.fromkeys(fields))
    met = polygon_overlay(left, targets, "left" if keep_unweighted else "inner")
    s, t = F.col("l"), F.col("r")
    alone = t.isNull()
    parts = met.select(
        geo.geometry_key(s["geometry"]).alias("source"), F.when(alone, geo.geometry_key(s["geometry"])).otherwise(geo.geometry_key(t["geometry"])).alias("target"),
        F.when(alone, s["geometry"]).otherwise(t["geometry"]).alias("geometry"), "part", alone.alias("alone"),
        *[s[f].cast("double").alias(f"_v_{f}") for f in dict.fromkeys(fields)],
        *[F.when(alone, 1.0).otherwise(_or_zero(t[w])).alias(f"_w_{w}") for w in weights],
    )
    covered = F.sum("part").over(Window.partitionBy("target", "alone"))
    parts = parts.withColumn("share", F.when(F.col("alone"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("part"), covered), F.lit(0.0))))
    rates, results = [], []
    for f in dict.fromkeys(fields):
        for w in weights:
            weight = F.sum(F.col(f"_w_{w}") * F.col("share"))
            name = f"{f}_disag_{w}"
            rates.append((F.max(f"_v_{f}") / F.when(weight == 0, F.count(F.lit(1)).cast("double")).otherwise(weight)).alias(f"_r_{name}"))
            results.append(F.sum(F.col(f"_w_{w}") * F.col("share") * F.col(f"_r_{name}")).alias(name))
    rate = parts.groupBy("source").agg(*rates)
    grouped = parts.join(rate, "source").groupBy("target").agg(F.first("geometry").alias("geometry"), *results)
    carried = [c for c in targets.columns if c != "geometry" and c not in grouped.columns]
    own = targets.select(geo.geometry_key(F.col("geometry")).alias("target"), *carried)
    return grouped.join(own, "target", "left").drop("target")
