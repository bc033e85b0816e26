"""Layers derived from the test tables, as frames and as SQL.

Tables without geometry are laid out on the square from 0 to 1000 by integer arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.geohash import DIGITS, SIZE
from ..operators.grid import make_grid

SIDE, CELL = 1000, 50
LAST = SIDE // CELL
AREA = (0.0, 0.0, float(SIDE), float(SIDE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x / 100000.0 + 14.0, y / 100000.0 + 50.0


def grid(spark: SparkSession, cell: float = CELL, **more) -> DataFrame:
    return make_grid(AREA, cell, spark=spark, lonlat=lonlat, **more)


def _box(x: str, y: str, w: str, h: str) -> list[Column]:
    x0, y0 = F.expr(x), F.expr(y)
    return [geo.box(x0, y0, x0 + F.expr(w), y0 + F.expr(h)).alias("geometry")]


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), *_box("(o_orderkey * 7919) % 960", "(o_custkey * 104729) % 960", "5 + o_orderkey % 33", "5 + o_custkey % 29"), F.col("o_totalprice").alias("val"), F.col("o_orderstatus").alias("cat"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y = F.expr("(l_partkey * 37 + l_linenumber * 11) % 1000"), F.expr("(l_suppkey * 53 + l_orderkey * 17) % 1000")
    return li.select(geo.point(x, y).alias("geometry"), F.col("l_quantity").alias("val"), F.col("l_returnflag").alias("cat"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.expr("(p_partkey * 31) % 1000"), F.expr("(p_partkey * 47) % 1000")
    return p.select(F.col("p_partkey").alias("id"), geo.line((x, y), (x + F.expr("p_size * 4"), y + F.expr("p_size * 2"))).alias("geometry"), F.col("p_brand").alias("cat"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("n_nationkey").alias("id"), *_box("(n_nationkey % 5) * 200", "(n_nationkey div 5) * 200", "200", "200"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n_regionkey").alias("region"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), *_box("(s_suppkey * 7919) % 900", "(s_suppkey * 3571 + s_nationkey * 13) % 900", "20 + s_suppkey % 70", "20 + s_nationkey % 50"), F.abs("s_acctbal").alias("weight"))


def quarters(spark: SparkSession) -> DataFrame:
    k = spark.range(16).withColumnRenamed("id", "k")
    return k.select(F.col("k").alias("id"), *_box("(k % 4) * 250", "(k div 4) * 250", "250", "250"))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped polygons: a rectangle without its upper right quarter."""
    o = table(spark, sf_dir, "orders")
    x0, y0 = F.expr("(o_orderkey * 7919) % 900"), F.expr("(o_custkey * 104729) % 900")
    w, h = F.expr("10 + o_orderkey % 60"), F.expr("10 + o_custkey % 50")
    shape = geo.polygon((x0, y0), (x0 + w, y0), (x0 + w, y0 + h / 2), (x0 + w / 2, y0 + h / 2), (x0 + w / 2, y0 + h), (x0, y0 + h))
    return o.select(F.col("o_orderkey").alias("id"), shape.alias("geometry"))


BUILDINGS = """b AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 960 AS DOUBLE) AS x0,
  CAST((o_custkey * 104729) % 960 AS DOUBLE) AS y0, 5 + o_orderkey % 33 AS w, 5 + o_custkey % 29 AS h, o_totalprice AS val, o_orderstatus AS cat FROM orders))"""
POINTS = """p AS (SELECT CAST((l_partkey * 37 + l_linenumber * 11) % 1000 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_orderkey * 17) % 1000 AS DOUBLE) AS y,
  l_quantity AS val, l_returnflag AS cat FROM lineitem)"""
LINES = """l AS (SELECT *, xa + p_size * 4 AS xb, ya + p_size * 2 AS yb FROM (SELECT p_partkey AS id, p_size, CAST((p_partkey * 31) % 1000 AS DOUBLE) AS xa,
  CAST((p_partkey * 47) % 1000 AS DOUBLE) AS ya, p_brand AS cat FROM part))"""
DISTRICTS = """d AS (SELECT n_nationkey AS id, CAST((n_nationkey % 5) * 200 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 200 AS DOUBLE) AS y0,
  CAST((n_nationkey % 5) * 200 + 200 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 200 + 200 AS DOUBLE) AS y1,
  CAST(coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS DOUBLE) AS n, n_regionkey AS region FROM nation)"""
SITES = """s AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 900 AS DOUBLE) AS x0,
  CAST((s_suppkey * 3571 + s_nationkey * 13) % 900 AS DOUBLE) AS y0, 20 + s_suppkey % 70 AS w, 20 + s_nationkey % 50 AS h, abs(s_acctbal) AS weight FROM supplier))"""
QUARTERS = """q AS (SELECT k AS id, CAST((k % 4) * 250 AS DOUBLE) AS x0, CAST((k // 4) * 250 AS DOUBLE) AS y0, CAST((k % 4) * 250 + 250 AS DOUBLE) AS x1,
  CAST((k // 4) * 250 + 250 AS DOUBLE) AS y1 FROM range(16) t(k))"""


def grid_sql(cell: float = CELL, name: str = "g", off: float = 0.0) -> str:
    first, last = int((0 - off) // cell), int(-(-(SIDE - off) // cell))
    if last * cell + off > SIDE:
        last -= 1
    n = last - first
    x = f"CAST({first * cell + off} + ix * {cell} AS DOUBLE)"
    y = x.replace("ix", "iy")
    return (
        f"{name} AS (SELECT *, x0 >= 0 AND y0 >= 0 AND x1 <= {SIDE} AND y1 <= {SIDE} AS inside FROM (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, "
        f"{x} AS x0, {y} AS y0, {x} + {cell} AS x1, {y} + {cell} AS y1 FROM range({n + 1}) a(ix), range({n + 1}) c(iy)))"
    )


def touch_sql(a: str, b: str) -> str:
    return f"{a}.x0 <= {b}.x1 AND {a}.x1 >= {b}.x0 AND {a}.y0 <= {b}.y1 AND {a}.y1 >= {b}.y0"


def part_sql(*boxes: str) -> str:
    side = lambda v: f"greatest(0e0, least({', '.join(f'{b}.{v}1' for b in boxes)}) - greatest({', '.join(f'{b}.{v}0' for b in boxes)}))"
    return f"{side('x')} * {side('y')}"


def geohash_sql(lon: str, lat: str) -> str:
    bits = (5 * SIZE + 1) // 2
    axis = [f"least(CAST(floor(({lon} - (-180e0)) / 360e0 * {float(1 << bits)!r}e0) AS BIGINT), {(1 << bits) - 1})", f"least(CAST(floor(({lat} - (-90e0)) / 180e0 * {float(1 << bits)!r}e0) AS BIGINT), {(1 << bits) - 1})"]
    digits = []
    for k in range(SIZE):
        value = " + ".join(f"((({'xx' if i % 2 == 0 else 'yy'} >> {bits - 1 - i // 2}) & 1) << {4 - (i - 5 * k)})" for i in range(5 * k, 5 * k + 5))
        digits.append(f"substring('{DIGITS}', CAST({value} + 1 AS INTEGER), 1)")
    return f"reverse({' || '.join(digits)})", axis
