"""Raster cells as polygons or points, from ESRI ASCII grids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo

_HEAD = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


class RasterError(ValueError):
    """A file that is no ASCII grid."""


def _parse(path: str, text: str) -> Iterator[pd.DataFrame]:
    """Rows of one file: i (column), j (row from the top), value, and the place of the grid."""
    lines = text.splitlines()
    head, at = {}, 0
    while at < len(lines) and (p := lines[at].split()) and p[0].lower() in _HEAD:
        head[p[0].lower()] = float(p[1])
        at += 1
    if not {"ncols", "nrows", "cellsize"} <= set(head):
        raise RasterError(f"{path} is no ASCII grid")
    size, cols, rows = head["cellsize"], int(head["ncols"]), int(head["nrows"])
    x = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2 * ("xllcenter" in head))
    y = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2 * ("yllcenter" in head))
    values = " ".join(lines[at:]).split()
    if len(values) != cols * rows:
        raise RasterError(f"{path} has {len(values)} values, not {cols * rows}")
    none = head.get("nodata_value")
    for j in range(0, rows, 256):
        n = min(256, rows - j) * cols
        v = pd.to_numeric(pd.Series(values[j * cols : j * cols + n]))
        k = pd.RangeIndex(n)
        made = pd.DataFrame({"file": path, "i": k % cols, "j": j + k // cols, "value": v.to_numpy(float), "x": x, "y": y + rows * size, "size": size})
        yield made if none is None else made[made["value"] != none]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, i, j, value, x, y (the grid's upper left corner), size. Files are read in parallel; masked cells are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["value"], strict=True):
                yield from _parse(p, text)

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "file string, i int, j int, value double, x double, y double, size double")


def cells_to_layer(cells: DataFrame, points: bool = False, bands: dict[str, str] | None = None, area: tuple[float, float, float, float] | None = None, whole: bool = False, srid: int = 0) -> DataFrame:
    """A layer of raster cells, as squares or as their centres.

    bands: names of the value columns of `cells` and what they are called (default: value as band_1). whole: values are
    integers. area: only cells whose box meets it.
    """
    bands = bands or {"value": "band_1"}
    x0, y1 = F.col("x") + F.col("i") * F.col("size"), F.col("y") - F.col("j") * F.col("size")
    x1, y0 = x0 + F.col("size"), y1 - F.col("size")
    shape = geo.point((x0 + x1) / 2, (y0 + y1) / 2, srid) if points else geo.box(x0, y0, x1, y1, srid)
    if area is not None:
        cells = cells.where((x0 <= area[2]) & (x1 >= area[0]) & (y0 <= area[3]) & (y1 >= area[1]))
    return cells.select(*[F.col(c).cast("int" if whole else "double").alias(n) for c, n in bands.items()], shape.alias("geometry"))


def read_bands(spark: SparkSession, paths: dict[str, str], points: bool = False, area: tuple[float, float, float, float] | None = None, srid: int = 0) -> DataFrame:
    """Several one-band files of one shape as one layer; cells that any of them masks are left out."""
    joined = None
    for name, path in paths.items():
        one = read_cells(spark, path).select("i", "j", F.col("value").alias(name), "x", "y", "size")
        joined = one if joined is None else joined.join(one.select("i", "j", name), ["i", "j"])
    return cells_to_layer(joined, points, {n: n for n in paths}, area, srid=srid)
