"""Queries and operators over all of their input."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import ingest, learn
from gridloom.catalogue import layers as lay
from gridloom.functions import geometry as geo
from gridloom.functions import kernels
from gridloom.operators import models, wrangle
from gridloom.sources import tables

ORDERS = [(k, (k * 37) % 150 + 1) for k in range(1, 41)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return path


def test_all_orders_are_corners(spark, folder):
    """Every L reaches the kernels: hull by its closed form; buffers larger and smaller than the shape."""
    rows = {r["id"]: r for r in ingest.shape_buffer_idx(spark, folder).collect()}
    assert sorted(rows) == [k for k, _ in ORDERS] and all(r["fullness_index"] > 1 > r["depth_index"] >= 0 for r in rows.values())
    hulls = wrangle.shape_metrics(lay.corners(spark, folder), buffers=False).select("id", "area", "concavity_index", "detour_index").collect()
    assert len(hulls) == len(ORDERS)
    for r in hulls:
        w, h = 10 + r["id"] % 60, 10 + dict(ORDERS)[r["id"]] % 50
        assert math.isclose(r["area"], 0.75 * w * h) and math.isclose(r["concavity_index"], 1 - 0.75 / 0.875)
        assert math.isclose(r["detour_index"], 3.5449077 * math.sqrt(0.75 * w * h) / (1.5 * (w + h) + math.hypot(w, h) / 2), rel_tol=1e-6)
    fixed = wrangle.fix_geometries(lay.corners(spark, folder)).agg(F.count("geometry"), F.sum(geo.area(F.col("geometry")))).first()
    assert fixed[0] == len(ORDERS) and math.isclose(fixed[1], sum(0.75 * (10 + k % 60) * (10 + c % 50) for k, c in ORDERS))


def test_types_of_late_values(spark, tmp_path):
    """Values after the first 20,000 lines count for the types, and none is changed or lost."""
    path = tmp_path / "late.csv"
    early = "1;1;2020-01-05;7;4.0;12345678901234567890;"
    late = "3.7;2;someday;x;5;1;"
    path.write_text("\n".join(["a;b;c;d;e;f;g", *[early] * 20_500, late]) + "\n")
    made = tables.read_table(spark, str(path))
    assert [t for _, t in made.dtypes] == ["double", "bigint", "string", "string", "bigint", "string", "string"]
    assert tuple(made.where("d = 'x'").first()) == (3.7, 2, "someday", "x", 5, "1", None)
    assert made.where("a = 1 AND b = 1 AND c = '2020-01-05' AND d = '7' AND e = 4 AND f = '12345678901234567890'").count() == 20_500
    kinds = tmp_path / "late.csvt"
    kinds.write_text('"Integer","Integer","String","String","Integer","String","String"\n')
    with pytest.raises(Exception, match="not a bigint: 3.7"):
        tables.read_table(spark, str(path), types=str(kinds)).collect()


def test_svr_learns_from_rows_after_the_first_2000():
    x = np.concatenate([np.linspace(-3, -1, 2000), np.linspace(1, 3, 400)])[:, None]
    y = np.where(x[:, 0] < 0, 0.0, 10.0)
    made = models._numpy_predict("svr", models._numpy_fit("svr", x, y, 0), np.array([[-2.0], [2.0]]))
    assert np.allclose(made, [0, 10], atol=0.5)


def test_shapley_values_of_many_rows():
    """Against the sum over all orders in which the features become known."""
    leaf = lambda v, n: {"value": v, "size": n, "feature": -1}
    split = lambda f, t, n, left, right: {"value": 0.0, "size": n, "feature": f, "threshold": t, "left": left, "right": right}
    nodes = [split(0, 0.0, 10.0, 1, 4), split(1, 0.5, 4.0, 2, 3), leaf(1.0, 1.0), leaf(5.0, 3.0), split(0, 1.0, 6.0, 5, 6), leaf(-2.0, 2.0), split(2, 0.0, 4.0, 7, 8), leaf(9.0, 1.0), leaf(4.0, 3.0)]

    def value(row, known, at=0):
        node = nodes[at]
        if node["feature"] < 0:
            return node["value"]
        sides = [node["left"], node["right"]]
        if node["feature"] in known:
            return value(row, known, sides[int(row[node["feature"]] > node["threshold"])])
        return sum(nodes[k]["size"] / node["size"] * value(row, known, k) for k in sides)

    x = np.random.default_rng(2).normal(size=(25, 3))
    want = np.zeros((25, 3))
    for i, row in enumerate(x):
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                want[i, f] += (value(row, order[: k + 1]) - value(row, order[:k])) / 6
    assert np.allclose(models.shapley_of_tree(nodes, x), want) and np.allclose(models.shapley_of_tree(nodes, x[0]), want[0])


def test_shap_tree_is_asked_for_all_cells(monkeypatch):
    asked = {}
    monkeypatch.setattr(learn, "frame", lambda *a: None)
    monkeypatch.setattr(learn, "wide", lambda *a: None)
    monkeypatch.setattr(learn.mod.Model, "train", staticmethod(lambda *a, **k: None))
    monkeypatch.setattr(learn.mod, "shap_values", lambda model, wide, rows=None, seed=None: asked.update(rows=rows) or _Frame())
    monkeypatch.setattr(learn.F, "round", lambda *a: _Frame())
    learn.shap_tree(None, "")
    assert asked == {"rows": None}


class _Frame:
    def select(self, *columns):
        return self

    def alias(self, name):
        return self


def test_lasso_is_the_minimum_with_features_that_are_much_alike(spark):
    """Half the mean squared error plus the absolute coefficients: its slope is 0 to rounding, whatever the correlation."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=600)
    x = np.column_stack([a, a + 0.05 * rng.normal(size=600), rng.normal(size=600), np.full(600, 3.0)])
    y = 9e4 * x[:, 0] - 5e4 * x[:, 1] + 0.1 * x[:, 2] + 2e5 + 1e4 * rng.normal(size=600)
    rows = [(f"g{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    names = ["a", "b", "c", "d"]
    frame = spark.createDataFrame(rows, "geohash string, a double, b double, c double, d double, label double").repartition(4)
    model = models.Model.train("lasso", frame, names)
    w = np.array([v for _, v in model.importances()])
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    slope = z.T @ (y - y.mean() - z @ w) / len(y)
    assert w[0] > 0 > w[1] and w[3] == 0 and np.allclose(slope[:2], np.sign(w[:2]), atol=1e-5) and (np.abs(slope) <= 1 + 1e-5).all()
    made = {r["geohash"]: r["weight"] for r in model.predict(frame).collect()}
    assert all(math.isclose(made[f"g{i}"], max(v, 0.0), rel_tol=1e-9, abs_tol=1e-4) for i, v in enumerate(y.mean() + z @ w))


def test_all_models_read_a_table_that_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: made.add(1) or v, "double").asNondeterministic()
    rows = spark.createDataFrame([(f"g{i}", float(i % 7), float(i)) for i in range(20)], "geohash string, a double, label double")
    trained = models.train_all(rows, ["a"], ("ols", "sgd", "knn"))
    wide = rows.select("geohash", seen("a").alias("a"))
    assert len(models.predict_all(trained, wide).collect()) == 20 and made.value == 20


def test_buffers_are_exact():
    """Closed forms of a square and an L, then polygons with holes, spikes and parts against many points, all at once."""
    ring = lambda *p: [*p, p[0]]
    square, corner = [[ring((5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0))]], [[ring((0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (5.0, 4.0), (5.0, 8.0), (0.0, 8.0))]]
    grown, shrunk = kernels.buffered_areas([square, corner, square, None, corner], [2.0, 1.0, 6.0, 1.0, float("nan")])
    assert np.allclose(grown[:3], [180 + 4 * math.pi, 60 + 36 + math.pi * 1.25 - 1, 340 + 36 * math.pi], rtol=1e-12) and np.isnan(grown[3:]).all()
    assert np.allclose(shrunk[:3], [36, 8 * 2 + 3 * 4 + 1 - math.pi / 4, 0], rtol=1e-12)
    rng = np.random.default_rng(1)
    star = [(float(r * math.cos(t)), float(r * math.sin(t))) for r, t in zip(rng.uniform(2, 9, 15), np.sort(rng.uniform(0, 2 * math.pi, 15)), strict=True)]
    holed = [[ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (3, 6), (6, 6), (6, 3))], [ring((12, 0), (15, 0), (15, 3))]]
    spiked = [[ring((0, 0), (10, 0), (10, 5), (14, 5), (10, 5), (10, 10), (0, 10))]]
    for parts in ([[ring(*star)]], holed, spiked):
        edges = np.array([(*a, *b) for part in parts for r in part for a, b in zip(r, r[1:], strict=False)], float)
        for d in (0.3, 1.0, 3.0):
            x, y = (v.ravel()[:, None] for v in np.meshgrid(np.arange(-14, 20, 0.05) + 0.025, np.arange(-14, 15, 0.05) + 0.025))
            ax, ay, bx, by = edges.T
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
            near = np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)).min(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = (((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))).sum(1) % 2 == 1
            want = [0.0025 * np.count_nonzero(inside | (near <= d)), 0.0025 * np.count_nonzero(inside & (near > d))]
            assert np.allclose(np.concatenate(kernels.buffered_areas([parts], [d])), want, atol=0.3)


@pytest.fixture(scope="module")
def many(spark):
    """More rows than were drawn before; places of equal features and equally far neighbours among them."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(5300, 2)), 1)
    y = np.round(3 * np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(size=5300), 3) + 5
    rows = [(f"g{i:05}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "geohash string, a double, b double, label double").repartition(3).persist()
    return frame, (x - x.mean(0)) / x.std(0), y


@pytest.mark.parametrize("kind", ["knn", "svr", "ann"])
def test_models_learn_from_all_rows(spark, many, tmp_path, monkeypatch, kind):
    """The same as over the whole arrays, whatever the rows' number, and when rows are sent or solved for in parts."""
    frame, z, y = many
    monkeypatch.setattr(models, "SENT", 60_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        model = models.Model.train(kind, frame, ["a", "b"], seed=3)
        model.save(str(tmp_path / kind))
        few = frame.where("substr(geohash, 6, 1) = '0'")
        made = [{r["geohash"]: r["weight"] for r in m.predict(few).collect()} for m in (model, models.Model.load(str(tmp_path / kind)))]
        assert made[0] == made[1] and len(made[0]) == 530
        got = np.array([made[0][f"g{i:05}"] for i in range(0, 5300, 10)])
        if kind == "svr":
            # No row at all misses the condition of the least loss.
            at, beta = models._gathered(model.rows, "at", "y")
            every = models._gathered(models.Model.train("knn", frame, ["a", "b"]).rows, "at", "x", "y")
            whole = np.zeros(len(y))
            whole[np.searchsorted(every[0], at)] = beta
            f = models._kernel(z, z) @ whole
            assert np.allclose(every[1], z) and np.array_equal(every[2], y)
            assert models._svr_missed(y, whole, f).max() < 1.1e-3 and np.allclose(got, np.maximum(f[::10], 0.0))
        elif kind == "knn":
            # Equally far neighbours are so to the last digit, so their features are taken as the model has them.
            x, labels = models._gathered(model.rows, "at", "x", "y")[1:]
            assert np.allclose(x, z) and np.array_equal(labels, y)
            near = np.argsort(((x[::10, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
            assert np.allclose(got, np.maximum(y[near].mean(1), 0.0))
        else:
            want = models._numpy_fit("ann", z, y, 3)
            assert math.isclose(model.parameters["mean"], y.mean()) and np.allclose(got, np.maximum(models._numpy_predict("ann", want, z[::10]), 0.0), atol=1e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_rows_and_one_feature(spark):
    rows = spark.createDataFrame([(f"g{i}", float(i), float(10 * i)) for i in range(3)], "geohash string, a double, label double")
    for kind in ("knn", "svr", "ann"):
        made = [r["weight"] for r in models.Model.train(kind, rows, ["a"]).predict(rows).collect()]
        assert len(made) == 3 and np.isfinite(made).all() and (kind != "knn" or made == [10, 10, 10])


def test_borders_come_from_all_rows(spark):
    """A value of one row in 60,000 has its own bin where values are few; bins of many values hold equal numbers of rows."""
    rows = spark.range(60_000).selectExpr("id % 9 + 0.0D AS a", "id * 7919 % 60000 + 0.0D AS b", "1.0D AS c").withColumn("a", F.when(F.col("b") == 777, 20.0).otherwise(F.col("a")))
    few, many_values, one = models._borders(rows, ["a", "b", "c"], 32)
    assert few == [0.5 + k for k in range(8)] + [14.0] and one == [0.0]
    assert many_values == [1875.0 * k - 0.5 for k in range(1, 32)]


def test_trees_see_every_row(spark):
    """One row of 20,000 stands alone: trees that learn from all rows, with thresholds of all rows, part it."""
    rows = spark.range(20_000).selectExpr("concat('g', id) AS geohash", "id % 5 + IF(id = 4321, 10.0D, 0.0D) AS a", "IF(id = 4321, 1000.0D, 0.0D) AS label")
    model = models.Model.train("extra", rows, ["a"], seed=1)
    assert all(any(n["feature"] == 0 for n in nodes) for _, nodes in models._trees(model))
    assert math.isclose(model.predict(rows.where("a > 9")).first()["weight"], 1000.0) and model.predict(rows.where("geohash = 'g3'")).first()["weight"] == 0.0
