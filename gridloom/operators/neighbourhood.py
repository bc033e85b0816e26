"""Gaussian neighbourhoods of cell features.

A two-dimensional Gaussian is two one-dimensional ones. Each pass joins cells with a small table of weights on their
index along one axis and adds up, so a blur is two aggregations, however large the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian cut off at four sigma (plus a half, rounded down), adding up to 1."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [(d - radius, w / sum(raw)) for d, w in enumerate(raw)]


def suffix(sigma: float) -> str:
    """0.5 is 0_5, 1.0 is 1."""
    return f"{sigma:g}".replace(".", "_")


def _pass(cells: DataFrame, axis: str, along: str, last: int, weights: list[tuple[int, float]], values: list[str]) -> DataFrame:
    """Each cell gives to the cells within reach along `axis`; the border's values are repeated beyond it.

    A border cell stands for all places beyond it, so its weight for a target is the sum over the offsets that end there.
    """
    reach = weights[-1][0]
    to = F.explode(F.sequence(F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.lit(last))))
    dealt = cells.withColumn("_t", to)
    ws = F.array(*[F.lit(w) for _, w in weights])
    d = F.col(axis) - F.col("_t")
    tail_low = F.array(*[F.lit(sum(w for o, w in weights if o <= k)) for k, _ in weights])
    tail_high = F.array(*[F.lit(sum(w for o, w in weights if o >= k)) for k, _ in weights])
    at = (d + reach).cast("int")
    if last == 0:
        weight = F.lit(1.0)
    else:
        weight = F.when(F.col(axis) == 0, tail_low[at]).when(F.col(axis) == last, tail_high[at]).otherwise(ws[at])
    dealt = dealt.withColumn("_w", weight)
    sums = [F.sum(F.col(v) * F.col("_w")).alias(v) for v in values]
    return dealt.groupBy(F.col("_t").alias(axis), along).agg(*sums)


def neighbourhood(features: DataFrame, columns: list[str], sigmas: list[float]) -> dict[str, DataFrame]:
    """For each column: geohash, ix, iy and neigh_<sigma> for each sigma (in cells).

    The average over the cells that have a value, weighed by distance; cells without a value stay null. The grid's
    bounding box ends the plane: its border is repeated beyond it, in values and in which cells have one.
    """
    ends = features.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1")).first()
    out = {}
    for c in columns:
        value = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
        cells = features.select("geohash", (F.col("ix") - F.lit(ends["x0"])).alias("_x"), (F.col("iy") - F.lit(ends["y0"])).alias("_y"), "ix", "iy", value.alias("_v"))
        made = cells
        for s in sigmas:
            start = cells.where("_v IS NOT NULL").select("_x", "_y", F.col("_v").alias("_n"), F.lit(1.0).alias("_m"))
            w = kernel(s)
            rows = _pass(start, "_x", "_y", ends["x1"] - ends["x0"], w, ["_n", "_m"])
            both = _pass(rows, "_y", "_x", ends["y1"] - ends["y0"], w, ["_n", "_m"])
            name = f"neigh_{suffix(s)}"
            made = made.join(both, ["_x", "_y"], "left").withColumn(name, F.when(F.col("_v").isNotNull(), F.try_divide("_n", "_m"))).drop("_n", "_m")
        out[c] = made.select("geohash", "ix", "iy", *[f"neigh_{suffix(s)}" for s in sigmas])
    return out
