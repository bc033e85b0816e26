"""Calibration of raw results to known values by one-dimensional regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative change of the error at which it has settled, least residual that weighs, and steps after which it is an error.
TOLERANCE, LEAST, MOST_STEPS = 1e-7, 1e-3, 5000


class CalibrationError(RuntimeError):
    """The error does not settle."""


def _sums(weight) -> list:
    x, y, w = F.col("x"), F.col("y"), weight
    return [F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy")]


def _line(r, intercept: bool) -> tuple[float, float]:
    """Slope and intercept of a weighted least-squares line, from its sums."""
    if not r["w"]:
        return 0.0, 0.0
    if not intercept:
        return (r["xy"] / r["xx"] if r["xx"] else 0.0), 0.0
    spread = r["xx"] - r["x"] ** 2 / r["w"]
    slope = (r["xy"] - r["x"] * r["y"] / r["w"]) / spread if spread else 0.0
    return slope, (r["y"] - slope * r["x"]) / r["w"]


def fit(df: DataFrame, raw: str, known: str, kind: str = "sum", intercept: bool = True) -> tuple[float, float]:
    """Slope and intercept: `sum` matches totals (and has no intercept), `ols` least squares, `lad` least absolute
    deviations by iteratively reweighted least squares until the relative error settles."""
    xy = df.select(F.col(raw).cast("double").alias("x"), F.col(known).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if kind == "sum":
        r = xy.agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
        return (r["y"] / r["x"] if r["x"] else 0.0), 0.0
    if kind == "ols":
        return _line(xy.agg(*_sums(F.lit(1.0))).first(), intercept)
    if kind != "lad":
        raise ValueError(f"unknown calibrator: {kind}")
    xy = xy.persist()
    try:
        first = xy.agg(*_sums(F.lit(1.0)), F.sum("y").alias("total")).first()
        total, last = abs(first["total"] or 0.0) or 1.0, None
        line = best = _line(first, intercept)
        for _ in range(MOST_STEPS):
            # One pass gives the error of this line and the sums of the next.
            miss = F.abs(F.col("x") * line[0] + line[1] - F.col("y"))
            r = xy.agg(*_sums(1 / F.greatest(miss, F.lit(LEAST))), F.sum(miss).alias("error")).first()
            error = (r["error"] or 0.0) / total
            if last is not None and abs(error - last) < TOLERANCE:
                return line if error <= last else best
            last, best, line = error, line, _line(r, intercept)
        raise CalibrationError(f"the error has not settled after {MOST_STEPS} steps")
    finally:
        xy.unpersist()


def calibrate(df: DataFrame, raw: str, known: str, output: str, kind: str = "sum", intercept: bool = True) -> DataFrame:
    """The table with a column `output`: the calibrated raw value, not below 0."""
    slope, base = fit(df, raw, known, kind, intercept)
    return df.withColumn(output, F.greatest(F.col(raw).cast("double") * slope + base, F.lit(0.0)))
