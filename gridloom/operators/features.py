"""Cell features from layers: eight methods, optionally by category; conditions and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .overlay import summed

#: Methods that need a source field.
WITH_SOURCE = ("sum", "avg", "wavg", "dsum", "davg")
WITHOUT_SOURCE = ("dens", "len", "cov")


class FeatureError(ValueError):
    """A request for a feature that can't be computed."""


def _terms(method: str, value: Column | None) -> tuple[Column, Column, str]:
    """What is summed over a cell's features, what it is divided by, and how that is aggregated."""
    g, cell = F.col("item")["geometry"], F.col("cell")
    cell_area, item_area = geo.box_area(cell), F.when(F.col("item").isNotNull(), geo.area(g))
    inside = F.when(F.col("item").isNotNull(), geo.area_within(geo.snapped(g), cell))
    one = F.lit(1.0)
    return {
        "dens": lambda: (one, cell_area, "sum"),
        "len": lambda: (F.when(F.col("item").isNotNull(), geo.length_within(geo.snapped(g), cell)), cell_area, "sum"),
        "cov": lambda: (inside, cell_area, "max"),
        "sum": lambda: (value, one, "one"),
        "avg": lambda: (value, one, "count"),
        "wavg": lambda: (value * item_area, item_area, "sum"),
        "dsum": lambda: (value * F.try_divide(inside, item_area), one, "one"),
        "davg": lambda: (value * inside, inside, "sum"),
    }[method]()


def categories(layer: DataFrame, field: str) -> list:
    """The distinct values of a column, sorted, without null; [None] if there are none."""
    return sorted(r[0] for r in layer.select(field).where(F.col(field).isNotNull()).distinct().collect()) or [None]


def _as_name(value: object) -> str:
    return str(value).replace(".", "_")


def calculate(grid: DataFrame, layer: DataFrame, methods: str | list[str], sources: str | list[str] | None = None, case: str | None = None) -> DataFrame:
    """One row per cell: geohash, ix, iy and a column for each method, source and category.

    Methods: dens (count by cell area), len and cov (length and area inside, by cell area), sum, avg, wavg (weighed by
    the features' whole area), dsum (the share of the value that lies inside), davg (weighed by the area inside).
    Columns are <method>[_<source>][_<case>_<value>]. With a category only what is summed is restricted to it, not what
    it is divided by. A cell that no feature touches has null, or 0 with a category; where the divisor is 0 the value is 0.
    """
    methods = [methods] if isinstance(methods, str) else list(methods)
    sources = [sources] if isinstance(sources, str) else list(sources or [])
    for m in methods:
        if m not in WITH_SOURCE + WITHOUT_SOURCE:
            raise FeatureError(f"unknown method: {m}")
        if m in WITH_SOURCE and not sources:
            raise FeatureError(f"method {m} needs a source field")
    values = categories(layer, case) if case else []
    used = ["geometry", *dict.fromkeys([*sources, *([case] if case else [])])]
    columns, sums = [], []
    for m in methods:
        for s in sources if m in WITH_SOURCE else [None]:
            num, den, kind = _terms(m, F.col("item")[s].cast("double") if s else None)
            stem = m + (f"_{s}" if s else "")
            low = f"_{len(sums)}"
            sums.append((low, den, kind))
            for value in values or [None]:
                if case:
                    hit = F.col("item")[case] == F.lit(value)
                    top, name = F.when(hit, num).otherwise(0.0), f"{stem}_{case}_{_as_name(value)}"
                else:
                    top, name = num, stem
                columns.append((name, f"_{len(sums)}", low))
                sums.append((f"_{len(sums)}", top, "sum"))
    made = summed(grid, layer.select(*used), sums)
    out = [F.when(F.col(low) == 0, 0.0).otherwise(F.col(top) / F.nullif(F.col(low), F.lit(0.0))).alias(name) for name, top, low in columns]
    return made.select("geohash", "ix", "iy", *out)


def feature_density(grid: DataFrame, layer: DataFrame) -> DataFrame:
    """How many features touch a cell, by its area: 0 in empty cells."""
    made = summed(grid, layer.select("geometry"), [("n", F.when(F.col("item").isNotNull(), 1.0).otherwise(0.0), "sum"), ("area", geo.box_area(F.col("cell")), "max")])
    return made.select("geohash", "ix", "iy", (F.col("n") / F.col("area")).alias("dens_true"))


def line_density(grid: DataFrame, layer: DataFrame) -> DataFrame:
    """Length of lines inside a cell, by its area: 0 in empty cells."""
    run = F.when(F.col("item").isNotNull(), geo.length_within(F.col("item")["geometry"], F.col("cell"))).otherwise(0.0)
    made = summed(grid, layer.select("geometry"), [("run", run, "sum"), ("area", geo.box_area(F.col("cell")), "max")])
    return made.select("geohash", "ix", "iy", (F.col("run") / F.col("area")).alias("len_true"))


def condition(grid: DataFrame, layer: DataFrame, expression: str | None = None) -> DataFrame:
    """geohash, ix, iy, condition: whether any feature that touches the cell satisfies a SQL expression on its columns.

    Without an expression it is true for every cell, empty ones included.
    """
    if expression and ";" in expression:
        raise FeatureError("an expression must be a single one")
    layer = layer.withColumn("_holds", F.expr(expression) if expression else F.lit(True)).select("geometry", "_holds")
    holds = F.when(F.col("item")["_holds"], 1).otherwise(0) if expression else F.lit(1)
    return summed(grid, layer, [("holds", holds, "max")]).select("geohash", "ix", "iy", (F.col("holds") > 0).alias("condition"))


def target(grid: DataFrame, layer: DataFrame, source: str, relative: bool = False) -> DataFrame:
    """geohash, ix, iy, target: a layer's value by cell.

    Points are added up, polygons by the share of their area inside; relative values are averaged instead.
    """
    first = layer.select(F.col("geometry")["type"].alias("t")).where("t IS NOT NULL").first()
    kind = first["t"] if first else None
    if kind not in ("Point", "Polygon", "MultiPolygon", "Box"):
        raise FeatureError(f"a target needs points or polygons, not {kind}")
    method = {(True, False): "sum", (True, True): "avg", (False, False): "dsum", (False, True): "davg"}[(kind == "Point", relative)]
    made = calculate(grid, layer, method, source)
    return made.withColumnRenamed(f"{method}_{source}", "target")
