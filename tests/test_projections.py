"""Projections against published points, calibrators and models against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.functions import project
from gridloom.operators import calibrate, models

#: EPSG code, longitude, latitude, easting, northing (EPSG guidance note 7-2 and the meridian arc of WGS 84).
POINTS = [
    (3035, 5.0, 50.0, 3962799.45, 2999718.85), (3035, 10.0, 52.0, 4321000.0, 3210000.0),
    (3857, -100.33333333, 24.38178694, -11169055.58, 2800000.0), (32632, 9.0, 0.0, 500000.0, 0.0), (32632, 9.0, 60.0, 500000.0, 6651411.19),
    (32732, 9.0, -60.0, 500000.0, 10000000 - 6651411.19),
]


def test_published_points(spark):
    for srid, lon, lat, x, y in POINTS:
        row = spark.createDataFrame([(lon, lat, x, y)], "lon double, lat double, x double, y double").select(
            project.moved(F.col("lon"), F.col("lat"), 4326, srid).alias("there"), project.moved(F.col("x"), F.col("y"), srid, 4326).alias("back")
        ).first()
        assert row["there"]["x"] == pytest.approx(x, abs=0.1) and row["there"]["y"] == pytest.approx(y, abs=0.1), srid
        assert row["back"]["x"] == pytest.approx(lon, abs=2e-6) and row["back"]["y"] == pytest.approx(lat, abs=2e-6), srid


def test_geometries_move(spark):
    df = spark.createDataFrame([(5.0, 50.0)], "x double, y double")
    g = project.transform_geometry(geo.point(F.col("x"), F.col("y"), 4326), 4326, 3035)
    box = project.transform_geometry(geo.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1, 4326), 4326, 32632)
    row = df.select(g.alias("g"), box.alias("b")).first()
    assert row["g"]["box"]["x0"] == pytest.approx(3962799.45, abs=0.1) and row["b"]["type"] == "Polygon"
    assert row["b"]["box"]["x1"] - row["b"]["box"]["x0"] > 60000


def test_unknown_system():
    with pytest.raises(project.UnknownProjection):
        project.transform(F.lit(0.0), F.lit(0.0), 4326, 12345)


def test_least_absolute_deviations(spark):
    """The best line goes through two of the points: all pairs are tried."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 50, 40)
    y = 3 * x + 7 + rng.normal(0, 2, 40)
    y[::7] += 200
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "raw double, known double")
    cost = lambda k, c: np.abs(k * x + c - y).sum()
    best = min(cost(k, y[i] - k * x[i]) for i, j in itertools.combinations(range(40), 2) for k in [(y[j] - y[i]) / (x[j] - x[i])])
    assert cost(*calibrate.fit(df, "raw", "known", "lad")) <= best * 1.001
    slope, base = calibrate.fit(df, "raw", "known", "lad", intercept=False)
    assert base == 0 and cost(slope, 0) <= min(cost(b / a, 0) for a, b in zip(x, y, strict=True)) * 1.001


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = np.maximum(0, 5 + x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.3, 300))
    df = spark.createDataFrame([(f"c{i:03d}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "geohash string, a double, b double, c double, label double")
    return x, y, df.persist()


def test_linear_models(rows):
    x, y, df = rows
    z = (x - x.mean(0)) / x.std(0)
    for kind, penalty in (("ridge", 1.0), ("sgd", 1e-4 * len(y)), ("ols", 0.0)):
        want = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ (y - y.mean()))
        got = [v for _, v in models.Model.train(kind, df, ["a", "b", "c"]).importances()]
        assert np.allclose(got, want, atol=1e-4), kind


def test_nearest_neighbours(rows):
    x, y, df = rows
    z = (x - x.mean(0)) / x.std(0)
    got = models.Model.train("knn", df, ["a", "b", "c"], seed=1).predict(df).orderBy("geohash").toPandas()["weight"].to_numpy()
    near = np.argsort(((z[:, None] - z[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
    assert np.allclose(got, y[near].mean(1), atol=1e-6)


@pytest.mark.parametrize("kind", ["extra", "rfor"])
def test_forests_have_many_trees(rows, kind):
    x, y, df = rows
    model = models.Model.train(kind, df, ["a", "b", "c"], seed=1)
    assert len({t.toDebugString for t in model.pipeline.stages[-1].trees}) >= 99
    got = model.predict(df).orderBy("geohash").toPandas()["weight"].to_numpy()
    assert 1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8
