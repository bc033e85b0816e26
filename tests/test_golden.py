"""Hand-computed results of the spatial operators."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.functions import kernels
from gridloom.functions.geohash import geohash
from gridloom.functions.translate import Translation
from gridloom.operators import calibrate, consolidate, disaggregate, features, neighbourhood, transfer, validate
from gridloom.operators.grid import make_grid


@pytest.fixture(scope="module")
def grid(spark):
    return make_grid((0, 0, 200, 200), 100, spark=spark).persist()


def boxes(spark, rows, schema):
    made = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, " + schema)
    rest = [c for c in made.columns if c not in ("x0", "y0", "x1", "y1")]
    return made.select(geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry"), *rest)


def by_cell(df, column):
    return {(r["ix"], r["iy"]): r[column] for r in df.collect()}


def test_grid(grid):
    rows = grid.collect()
    assert len(rows) == 9 and len({r["geohash"] for r in rows}) == 9
    assert {(r["ix"], r["iy"]) for r in rows if r["inside"]} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_overlay_methods(spark, grid):
    layer = boxes(spark, [(50.0, 0.0, 150.0, 100.0, 10.0, "a")], "val double, cat string")
    made = features.calculate(grid, layer, ["cov", "sum", "avg", "wavg", "dsum", "davg", "dens"], "val").collect()
    rows = {(r["ix"], r["iy"]): r for r in made}
    inside, touching, empty = rows[0, 0], rows[0, 1], rows[2, 2]
    assert [inside[c] for c in ("cov", "sum_val", "avg_val", "wavg_val", "dsum_val", "davg_val")] == [0.5, 10, 10, 10, 5, 10]
    assert [touching[c] for c in ("cov", "sum_val", "avg_val", "wavg_val", "dsum_val", "davg_val")] == [0, 10, 10, 10, 0, 0]
    assert all(empty[c] is None for c in ("cov", "sum_val", "avg_val", "wavg_val", "dsum_val", "davg_val"))
    assert {r["dens"] for r in made} == {0.0001}
    cased = by_cell(features.calculate(grid, layer, "cov", case="cat"), "cov_cat_a")
    assert (cased[0, 0], cased[2, 2]) == (0.5, 0)
    assert set(by_cell(features.condition(grid, layer), "condition").values()) == {True}
    assert sum(by_cell(features.condition(grid, layer, "val > 5"), "condition").values()) == 4


def test_wrong_requests(spark, grid):
    layer = boxes(spark, [(0.0, 0.0, 1.0, 1.0, 1)], "id int")
    with pytest.raises(features.FeatureError):
        features.calculate(grid, layer, "sum")
    with pytest.raises(features.FeatureError):
        features.calculate(grid, layer, "mode", "id")


def test_disaggregation(spark, grid):
    sources = boxes(spark, [(0.0, 0.0, 100.0, 200.0, 30.0), (100.0, 0.0, 200.0, 200.0, 50.0)], "n double")
    w = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 0.0, (1, 1): 0.0}
    weights = grid.select("geohash", F.coalesce(*[F.when((F.col("ix") == i) & (F.col("iy") == j), v) for (i, j), v in w.items()]).alias("weight"))
    single = by_cell(disaggregate.disaggregate(grid, sources, "n", weights), "value")
    assert {k: round(single[k], 9) for k in w} == {(0, 0): 10, (0, 1): 20, (1, 0): 0, (1, 1): 0} and len(single) == 9
    batch = by_cell(disaggregate.disaggregate_batch(grid, sources, "n", weights), "weight")
    assert {k: round(v, 9) for k, v in batch.items()} == {(0, 0): 10, (0, 1): 20, (1, 0): 25, (1, 1): 25}
    with pytest.raises(NotImplementedError):
        disaggregate.disaggregate(grid, sources, "n", weights, relative=True)


def test_transfer(spark, grid):
    source = boxes(spark, [(0.0, 0.0, 200.0, 100.0, 1, 100.0)], "id int, v double")
    targets = boxes(spark, [(0.0, 0.0, 100.0, 100.0, 1), (100.0, 0.0, 200.0, 100.0, 2)], "id int")
    aux = boxes(spark, [(0.0, 0.0, 100.0, 100.0, 1.0), (100.0, 0.0, 200.0, 100.0, 3.0)], "weight double")
    table = transfer.transfer_weights(source, "id", targets, "id", aux)
    assert {r["to_id"]: r["transfer_weight"] for r in table.collect()} == {1: 0.25, 2: 0.75}
    assert {r["id"]: r["v"] for r in transfer.apply_transfer(source, "id", "v", targets, "id", table).collect()} == {1: 25, 2: 75}


def test_neighbourhood(spark):
    row = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 1, 0, None), ("c", 2, 0, 3.0)], "geohash string, ix int, iy int, v double")
    got = by_cell(neighbourhood.neighbourhood(row, ["v"], [0.5])["v"], "neigh_0_5")
    assert (round(got[0, 0], 7), got[1, 0], round(got[2, 0], 7)) == (1.0005906, None, 2.9994094)
    assert (neighbourhood.suffix(0.5), neighbourhood.suffix(1.0)) == ("0_5", "1")


def test_validation_and_calibration(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0)], "target double, value double")
    r = validate.validate_raw(df).first()
    assert (r["diff"], r["tae"], r["rtae"], round(r["r2"], 9), round(r["rmse"], 8)) == (0, 2, 0.2, 0.6, 0.70710678)
    raw = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 8.0)], "raw double, known double")
    assert [r["out"] for r in calibrate.calibrate(raw, "raw", "known", "out").collect()] == [2, 4, 6]


def test_translation_and_names(spark):
    codes = spark.createDataFrame([("14100",), ("21000",), ("91000",)], "c string")
    made = codes.select(Translation({"14": 14, "2": 2}, leading=True, default=None).column(F.col("c")).alias("v"))
    assert [r["v"] for r in made.collect()] == [14, 2, None]
    assert consolidate.column_name("feat_building", "cov") == "building_cov"
    assert consolidate.column_name("feat_neigh_building_cov", "neigh_1") == "building_cov_neigh_1"


def test_geohash(spark):
    assert spark.range(1).select(geohash(F.lit(-126.0), F.lit(48.0)).alias("h")).first()["h"] == "c0w3hf1s70w3hf1s70w3"


def test_polygon_area_in_cell_equals_kernel(spark):
    star = [(50 + (40 if k % 2 else 15) * math.cos(k * math.pi / 5), 50 + (40 if k % 2 else 15) * math.sin(k * math.pi / 5)) for k in range(10)]
    shape = geo.polygon(*[(F.lit(x), F.lit(y)) for x, y in star])
    cell = F.struct(F.lit(30.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(70.0).alias("x1"), F.lit(60.0).alias("y1"))
    got = spark.range(1).select(geo.area_within(shape, cell).alias("a")).first()["a"]
    square = [(30.0, 20.0), (70.0, 20.0), (70.0, 60.0), (30.0, 60.0)]
    assert got == pytest.approx(kernels.overlap_area([[star]], [[square]]), rel=1e-9)
