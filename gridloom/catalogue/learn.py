"""Models: training, prediction, introspection, Shapley values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import models as mod
from . import layers as lay
from .cells import _NUMBER, _OVER_B, rounded
from .layers import BUILDINGS, POINTS, grid_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = ["cov", "sum_val"]


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def wide(spark, sf_dir) -> DataFrame:
    return feat.calculate(lay.grid(spark), lay.buildings(spark, sf_dir), ["cov", "sum"], "val")


def frame(spark, sf_dir) -> DataFrame:
    goal = feat.target(lay.grid(spark), lay.points(spark, sf_dir), "val")
    return mod.training_frame(wide(spark, sf_dir), goal, FEATURES).persist()


_FRAME = f"""WITH {grid_sql()}, {BUILDINGS}, {_OVER_B}, {POINTS},
fx AS (SELECT ix, iy, coalesce(sum(CASE WHEN id IS NOT NULL THEN part END) / {_NUMBER}, 0e0) AS a, coalesce(sum(val), 0e0) AS b FROM o GROUP BY ix, iy),
fy AS (SELECT g.ix, g.iy, coalesce(sum(p.val), 0e0) AS y FROM g LEFT JOIN p ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1 GROUP BY g.ix, g.iy),
xy AS (SELECT * FROM fx JOIN fy USING (ix, iy)),
mo AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM xy),
co AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM mo)"""


@query(f"{_FRAME} SELECT 'cov' AS feature, round(ca * sqrt(aa), 3) AS value FROM co UNION ALL SELECT 'sum_val', round(cb * sqrt(bb), 3) FROM co")
def model_ols_coef(spark, sf_dir):
    made = mod.Model.train("ols", frame(spark, sf_dir), FEATURES).importances()
    return spark.createDataFrame(made, "feature string, value double").select("feature", F.round("value", 3).alias("value"))


def _predict(kind: str, digits: int = 3):
    def run(spark, sf_dir):
        model = mod.Model.train(kind, frame(spark, sf_dir), FEATURES, seed=1)
        return rounded(model.predict(wide(spark, sf_dir)).join(lay.grid(spark).select("geohash", "ix", "iy"), "geohash"), digits)

    return run


_PREDICTED = f"{_FRAME} SELECT ix, iy, round(greatest(my + ca * (a - ma) + cb * (b - mb), 0), 3) AS weight FROM xy, co"
query(_PREDICTED, "model_ols_predict")(_predict("ols"))
#: Standardised moments, and the prediction from coefficients wa and wb on standardised features.
_UNIT = f"{_FRAME}, st AS (SELECT *, (SELECT count(*) FROM xy) AS n, ay / sqrt(aa) AS ca1, by_ / sqrt(bb) AS cb1, ab / sqrt(aa * bb) AS rho FROM mo)"
_FROM_UNIT = "SELECT ix, iy, round(greatest(my + wa * (a - ma) / sqrt(aa) + wb * (b - mb) / sqrt(bb), 0), 1) AS weight FROM xy, st, w"


def _penalised(penalty: str) -> str:
    """Least squares with `penalty` on the squared coefficients beside the sum of squared errors."""
    return f"{_UNIT}, w AS (SELECT (ca1 * (1 + k) - cb1 * rho) / ((1 + k) * (1 + k) - rho * rho) AS wa, (cb1 * (1 + k) - ca1 * rho) / ((1 + k) * (1 + k) - rho * rho) AS wb FROM (SELECT *, {penalty} / n AS k FROM st)) {_FROM_UNIT}"


_SOFT = "sign({0}) * greatest(abs({0}) - 1, 0)"
_LASSO = (
    f"{_UNIT.replace('WITH ', 'WITH RECURSIVE ', 1)}, turns(i, wa, wb) AS (SELECT 0, 0e0, 0e0 UNION ALL "
    f"SELECT i + 1, na, {_SOFT.format('(cb1 - rho * na)')} FROM (SELECT i, {_SOFT.format('(ca1 - rho * wb)')} AS na, ca1, cb1, rho FROM turns, st WHERE i < 400)), "
    f"w AS (SELECT wa, wb FROM turns WHERE i = 400) {_FROM_UNIT}"
)
_SQL = {"ols": _PREDICTED, "ridge": _penalised("1e0"), "sgd": _penalised("1e-4 * n"), "lasso": _LASSO}
for _kind in mod.TYPES:
    if _kind != "ols":
        query(_SQL.get(_kind), f"model_{_kind}")(_predict(_kind, 1 if _kind in _SQL else 3))


@query(f"{_FRAME} SELECT ix, iy, round(greatest(my + ca * (a - ma) + cb * (b - mb) - 2 * my, 0), 3) AS weight FROM xy, co")
def model_apply_clip(spark, sf_dir):
    """Labels moved down, so that many predictions are below 0."""
    rows = frame(spark, sf_dir)
    mean = rows.agg(F.avg("label")).first()[0]
    model = mod.Model.train("ols", rows.withColumn("label", F.col("label") - 2 * mean), FEATURES)
    return rounded(model.predict(wide(spark, sf_dir)).join(lay.grid(spark).select("geohash", "ix", "iy"), "geohash"), 3)


@query()
def model_array(spark, sf_dir):
    models = mod.train_all(frame(spark, sf_dir), FEATURES, seed=1)
    rows = [(k, f, v) for k, m in models.items() for f, v in m.importances()]
    return spark.createDataFrame(rows, "model string, feature string, value double").select("model", "feature", F.round("value", 4).alias("value"))


@query()
def model_array_apply(spark, sf_dir):
    models = mod.train_all(frame(spark, sf_dir), FEATURES, seed=1)
    return rounded(mod.predict_all(models, wide(spark, sf_dir)).join(lay.grid(spark).select("geohash", "ix", "iy"), "geohash"), 3)


_FIXED = [("building_cov", 0.5), ("building_cov_neigh_1", -0.25), ("poi_sum_val_neigh_0_5", 0.125), ("poi_sum_val", 0.0625)]
_FIXED_SQL = "f(feature, value) AS (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in _FIXED) + ")"


@query(
    f"WITH {_FIXED_SQL} SELECT grouping, name, sum(value) AS value, sum(abs(value)) AS weight FROM ("
    "SELECT 'source' AS grouping, split_part(feature, '_', 1) AS name, value FROM f UNION ALL "
    "SELECT 'range', CASE WHEN contains(feature, 'neigh') THEN split_part(feature, 'neigh_', 2) ELSE 'none' END, value FROM f UNION ALL "
    "SELECT 'core', CASE WHEN contains(feature, 'neigh') THEN split_part(feature, '_neigh', 1) ELSE feature END, value FROM f) GROUP BY grouping, name"
)
def introspect_grouped(spark, sf_dir):
    return mod.introspect_grouped(spark.createDataFrame(_FIXED, "feature string, value double"), coefficients=True)


@query(f"WITH {_FIXED_SQL} SELECT feature, value, abs(value) AS weight FROM f")
def introspect(spark, sf_dir):
    return mod.introspect(spark.createDataFrame(_FIXED, "feature string, value double"), coefficients=True)


@query()
def shap_tree(spark, sf_dir):
    model = mod.Model.train("rfor", frame(spark, sf_dir), FEATURES, seed=1)
    made = mod.shap_values(model, wide(spark, sf_dir))
    return made.select("geohash", "feature", F.round("shap", 6).alias("shap"))


