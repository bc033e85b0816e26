"""Transfer tables: sparse weights from one polygon layer to another by way of an ancillary density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.kernels import triple_area_udf
from .overlay import polygon_overlay


def transfer_weights(sources: DataFrame, source_id: str, targets: DataFrame, target_id: str, auxiliary: DataFrame, density: str = "weight", values: DataFrame | None = None, key: str = "geohash", value_key: str = "geohash") -> DataFrame:
    """from_id, to_id, transfer_weight: the share of a source's ancillary mass that lies in a target.

    auxiliary has polygons (often cells) with a density, or a key into `values`, which has it. Only positive densities
    and weights count; a source's weights add up to 1.
    """
    aux = auxiliary
    if values is not None:
        aux = aux.select("geometry", F.col(key).alias("_key")).join(values.select(F.col(value_key).alias("_key"), F.col(density).alias("_density")), "_key")
    else:
        aux = aux.select("geometry", F.col(density).alias("_density"))
    aux = aux.where("_density > 0").select("geometry", "_density")
    first = polygon_overlay(aux, sources.select(F.col(source_id).alias("id"), "geometry"))
    met = first.select(F.col("l.geometry").alias("geometry"), F.col("l._density").alias("_density"), F.col("r.id").alias("from_id"), F.col("r.geometry").alias("source"))
    both = polygon_overlay(met, targets.select(F.col(target_id).alias("id"), "geometry"))
    a, b, c = F.col("l")["geometry"], F.col("l")["source"], F.col("r")["geometry"]

    def boxed(x, y):
        lo, hi = F.greatest, F.least
        return F.struct(lo(x["x0"], y["x0"]).alias("x0"), lo(x["y0"], y["y0"]).alias("y0"), hi(x["x1"], y["x1"]).alias("x1"), hi(x["y1"], y["y1"]).alias("y1"))

    # Where the ancillary polygon and one of the others are boxes, their common box clips the third.
    empty = lambda x: (x["x1"] <= x["x0"]) | (x["y1"] <= x["y0"])
    ab, ac = boxed(a["box"], b["box"]), boxed(a["box"], c["box"])
    area = F.when((a["type"] == "Box") & (b["type"] == "Box"), F.when(empty(ab), 0.0).otherwise(geo.area_within(c, ab)))
    area = area.when((a["type"] == "Box") & (c["type"] == "Box"), F.when(empty(ac), 0.0).otherwise(geo.area_within(b, ac)))
    general = both.where(area.isNull()) if _has_shapes(sources, targets, auxiliary) else None
    chunks = both.withColumn("area", area).where("area IS NOT NULL")
    if general is not None:
        chunks = chunks.unionByName(general.withColumn("area", triple_area_udf(geo.parts_of(a), geo.parts_of(b), geo.parts_of(c))))
    chunks = chunks.select(F.col("l.from_id").alias("from_id"), F.col("r.id").alias("to_id"), (F.col("area") * F.col("l._density")).alias("weight"))
    sums = chunks.groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight")).where("weight > 0")
    totals = sums.groupBy("from_id").agg(F.sum("weight").alias("total"))
    return sums.join(totals, "from_id").select("from_id", "to_id", (F.col("weight") / F.col("total")).alias("transfer_weight"))


def _has_shapes(*layers: DataFrame) -> bool:
    return any(not d.where(F.col("geometry")["type"] != "Box").isEmpty() for d in layers)


def apply_transfer(sources: DataFrame, source_id: str, value: str, targets: DataFrame, target_id: str, transfers: DataFrame) -> DataFrame:
    """The targets' columns and `value`: the sources' values by their transfer weights. Targets that get nothing are left out."""
    moved = sources.select(F.col(source_id).alias("from_id"), F.col(value).cast("double").alias("_value")).join(transfers, "from_id")
    sums = moved.groupBy("to_id").agg(F.sum(F.col("_value") * F.col("transfer_weight")).alias("_sum"))
    kept = [c for c in targets.columns if c != value]
    return targets.join(sums, targets[target_id] == sums["to_id"]).select(*[targets[c] for c in kept], F.col("_sum").alias(value))
