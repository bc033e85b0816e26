"""One wide feature table, and the choice of its rows and columns."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "geohash"
PLACE = ("ix", "iy")


def column_name(table: str, column: str) -> str:
    """Name in the wide table: the table's without its prefix, and the column's unless they are the same."""
    stem = re.sub(r"^feat_(neigh_)?", "", table)
    return stem if column == stem else f"{stem}_{column}"


def assert_unique(df: DataFrame, key: str = KEY) -> DataFrame:
    """The frame itself, after a check that no key is null or occurs twice."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is not a key: {bad[0][key]!r} occurs {bad[0]['n']} times")
    return df


def consolidate(tables: dict[str, DataFrame], condition: DataFrame | None = None) -> DataFrame:
    """Inner join of feature tables on the cell, with a condition column (true for all cells without a condition table)."""
    renamed = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != KEY and c not in PLACE]
        renamed.append(df.select(KEY, *[F.col(c).alias(column_name(name, c)) for c in columns]))
    if condition is not None:
        renamed.append(condition.select(KEY, "condition"))
    wide = reduce(lambda a, b: a.join(b, KEY), renamed)
    return wide if condition is not None else wide.withColumn("condition", F.lit(True))


def feature_list(tables: dict[str, DataFrame], spark) -> DataFrame:
    """table, column, kind of every feature column."""
    rows = [(t, c, "neighbourhood" if t.startswith("feat_neigh_") else "feature") for t in sorted(tables) for c in tables[t].columns if c != KEY and c not in PLACE]
    return spark.createDataFrame(rows, "table string, column string, kind string")


def select_features(wide: DataFrame, pattern: str | None = None, invert: bool = False) -> list[str]:
    """Feature columns whose whole name matches (or does not match) a regular expression; all without one."""
    names = [c for c in wide.columns if c not in (KEY, "condition", *PLACE)]
    if pattern is None:
        return names
    return [c for c in names if bool(re.fullmatch(pattern, c)) != invert]


def inside_only(df: DataFrame, grid: DataFrame) -> DataFrame:
    return df.join(grid.where("inside").select(KEY), KEY, "left_semi")


def condition_only(df: DataFrame, wide: DataFrame) -> DataFrame:
    return df.join(wide.where("condition").select(KEY), KEY, "left_semi")


def with_features(wide: DataFrame, names: list[str]) -> DataFrame:
    """The named feature columns; those that are missing are 0 everywhere, and null and NaN are 0."""
    missing = [n for n in names if n not in wide.columns]
    if missing:
        logging.getLogger(__name__).warning("missing features are taken as 0: %s", ", ".join(missing))
    return wide.select(KEY, *[F.lit(0.0).alias(n) if n in missing else F.col(n).cast("double").alias(n) for n in names]).na.fill(0.0)


def merge_schemas(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the sorted union of their columns; what a frame lacks is null."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.select(*sorted(every.columns))


def subsample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Exactly int(n * fraction) rows, at random without replacement."""
    n = int(df.count() * fraction)
    if n == 0:
        raise ValueError("the sample is empty")
    return df.orderBy(F.rand(seed)).limit(n)
