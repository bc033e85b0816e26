"""Accuracy of modelled against true values."""

from __future__ import annotations

import html
import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import within_index
from .overlay import grid_shape

MULTIPLES = (2, 5, 10)
#: Percentiles of the description, by name.
PERCENTILES = {"median": 0.5, "q2_5": 0.025, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9, "q97_5": 0.975}


def metrics(true: Column, model: Column) -> list[Column]:
    """Difference and absolute error of totals, relative error, R2 (explained share of variance), root mean square error."""
    miss = model - true
    error = F.sum(F.abs(miss))
    return [
        F.sum(miss).alias("diff"), error.alias("tae"), F.try_divide(error, F.sum(true)).alias("rtae"),
        (1 - F.try_divide(F.sum(miss * miss), F.count(true) * F.var_pop(true))).alias("r2"),
        F.sqrt(F.try_divide(F.sum(miss * miss), F.count(true).cast("double"))).alias("rmse"),
    ]


def _filled(df: DataFrame, true: str, model: str) -> DataFrame:
    return df.select(F.col(true).cast("double").alias("t"), F.col(model).cast("double").alias("m")).na.fill(0.0)


def validate_raw(df: DataFrame, true: str = "target", model: str = "value") -> DataFrame:
    """One row of metrics for two columns of a table."""
    return _filled(df, true, model).agg(*metrics(F.col("t"), F.col("m")))


def aligned(grid: DataFrame, true_table: DataFrame, model_table: DataFrame, true: str, models: list[str]) -> DataFrame:
    """Every cell with its true and modelled values, 0 where there is none."""
    t = true_table.select("geohash", F.col(true).cast("double").alias("_true"))
    m = model_table.select("geohash", *[F.col(c).cast("double").alias(c) for c in models])
    return grid.join(t, "geohash", "left").join(m, "geohash", "left").na.fill(0.0, ["_true", *models])


def validate_model(grid: DataFrame, true_table: DataFrame, model_table: DataFrame, true: str = "target", model: str = "value") -> DataFrame:
    return aligned(grid.select("geohash"), true_table, model_table, true, [model]).agg(*metrics(F.col("_true"), F.col(model)))


def validate_array(grid: DataFrame, true_table: DataFrame, model_table: DataFrame, true: str = "target", models: list[str] | None = None) -> DataFrame:
    """A row of metrics for every model column, from one pass: model, diff, tae, rtae, r2, rmse."""
    models = models or [c for c in model_table.columns if c not in ("geohash", "ix", "iy")]
    both = aligned(grid.select("geohash"), true_table, model_table, true, models)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("m")) for m in models]))
    return both.select("_true", pairs.alias("p")).groupBy(F.col("p.model").alias("model")).agg(*metrics(F.col("_true"), F.col("p.m")))


def validate_multiscale(grid: DataFrame, true_table: DataFrame, model_table: DataFrame, true: str = "target", model: str = "value", multiples: tuple[int, ...] = MULTIPLES, area: tuple[float, float, float, float] | None = None, xoffset: float | None = None, yoffset: float | None = None) -> DataFrame:
    """A row of metrics for each multiple of the cell size: multiple, diff, tae, rtae, r2, rmse.

    Cells are added up to the coarse cells in which they lie. Coarse cells without any (they touch the area, or lie
    across its edge) count with 0 for both values. area: the box that the grid was made for (default: the grid's inside).
    """
    size, _, _ = grid_shape(grid)
    low = grid.agg(F.min("x0").alias("x"), F.min("y0").alias("y")).first()
    if area is None:
        e = grid.where("inside").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d")).first()
        area = (e["a"], e["b"], e["c"], e["d"])
    both = aligned(grid.select("geohash", "x0", "y0", "x1", "y1"), true_table, model_table, true, [model])
    levels = []
    for k in multiples:
        side = size * k
        ox, oy = (low["x"] if xoffset is None else xoffset) % side, (low["y"] if yoffset is None else yoffset) % side
        first = lambda v, off, side=side: int((v - off) // side)
        last = lambda v, off, side=side: int(-(-(v - off) // side))

        def span(lo: float, hi: float, off: float, side=side, first=first, last=last) -> tuple[int, int]:
            """Coarse indices whose cells touch the area."""
            b = last(hi, off)
            return first(lo, off), b if off + b * side <= hi else b - 1

        (xa, xb), (ya, yb) = span(area[0], area[2], ox), span(area[1], area[3], oy)
        count = (xb - xa + 1) * (yb - ya + 1)
        cells = within_index(both, side, ox, oy).where(F.col("cx").between(xa, xb) & F.col("cy").between(ya, yb))
        sums = cells.groupBy("cx", "cy").agg(F.sum("_true").alias("t"), F.sum(model).alias("m"))
        # Coarse cells without cells add nothing to the sums, only to the number of values.
        t, miss = F.col("t"), F.col("m") - F.col("t")
        got = sums.agg(F.sum(miss).alias("diff"), F.sum(F.abs(miss)).alias("tae"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"), F.sum(miss * miss).alias("sq"))
        spread = F.col("stt") - F.col("st") * F.col("st") / count
        levels.append(got.select(F.lit(k).alias("multiple"), "diff", "tae", F.try_divide("tae", "st").alias("rtae"), (1 - F.try_divide(F.col("sq"), spread)).alias("r2"), F.sqrt(F.col("sq") / count).alias("rmse")))
    return reduce(DataFrame.unionByName, levels)


def describe(df: DataFrame, true: str = "target", model: str = "value") -> DataFrame:
    """Distribution of modelled and true values, residuals and absolute residuals: kind, min, max, sum, mean, percentiles."""
    f = _filled(df, true, model)
    kinds = {"modeled": F.col("m"), "real": F.col("t"), "residuals": F.col("m") - F.col("t"), "abs_residuals": F.abs(F.col("m") - F.col("t"))}
    rows = f.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()])).alias("p")).select("p.*")
    exact = F.percentile("v", F.array(*[F.lit(q) for q in PERCENTILES.values()]))
    made = rows.groupBy("kind").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), exact.alias("q"))
    return made.select("kind", "min", "max", "sum", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(PERCENTILES)])


def write_levels(levels: DataFrame, path: str) -> None:
    """The levels of a multiscale validation as one CSV file with semicolons."""
    levels.orderBy("multiple").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def report(df: DataFrame, path: str, true: str = "target", model: str = "value", points: int = 2000) -> None:
    """An HTML page with metrics, distributions and a log-log scatter of `points` values drawn at random."""
    row = validate_raw(df, true, model).first().asDict()
    table = lambda names, rows: "<table><tr>" + "".join(f"<th>{html.escape(str(n))}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(f"<td>{v if isinstance(v, str) else format(v or 0.0, 'g')}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    dist = describe(df, true, model)
    drawn = _filled(df, true, model).where("t > 0 AND m > 0").orderBy(F.rand(1)).limit(points).select(F.log10("t").alias("x"), F.log10("m").alias("y")).collect()
    lo, hi = min([r["x"] for r in drawn] + [r["y"] for r in drawn], default=0.0), max([r["x"] for r in drawn] + [r["y"] for r in drawn], default=1.0)
    scale = lambda v: 380 * (v - lo) / ((hi - lo) or 1) + 10
    dots = "".join(f'<circle cx="{scale(r["x"]):.1f}" cy="{400 - scale(r["y"]):.1f}" r="1.5"/>' for r in drawn)
    page = f"<!doctype html><title>Validation</title>{table(list(row), [list(row.values())])}{table(dist.columns, [list(r) for r in dist.collect()])}<svg width='400' height='400'>{dots}</svg>"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
