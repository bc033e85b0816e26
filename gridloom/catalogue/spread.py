"""Disaggregation, transfer, calibration and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import disaggregate as dis
from ..operators import features as feat
from ..operators import transfer as tra
from ..operators import validate as val
from . import layers as lay
from .cells import rounded
from .layers import AREA, BUILDINGS, CELL, DISTRICTS, POINTS, QUARTERS, SITES, grid_sql, part_sql, touch_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def weights(spark, sf_dir) -> DataFrame:
    """Order quantities by cell, and half of them in the west only."""
    made = feat.calculate(lay.grid(spark), lay.points(spark, sf_dir), "sum", "val")
    west = F.when(F.col("ix") < 8, F.col("sum_val"))
    return made.select("geohash", F.col("sum_val").alias("weight"), west.alias("west"))


_W = "w AS (SELECT g.ix, g.iy, sum(p.val) AS weight, CASE WHEN g.ix < 8 THEN sum(p.val) END AS west FROM g LEFT JOIN p ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1 GROUP BY g.ix, g.iy)"
_PARTS = f"t AS (SELECT g.ix, g.iy, d.id, d.n, {part_sql('g', 'd')} AS part FROM g JOIN d ON {touch_sql('g', 'd')})"
_BASE = f"WITH {grid_sql()}, {POINTS}, {DISTRICTS}, {_W}, {_PARTS}"


def _single(column: str) -> str:
    return (
        f"{_BASE}, f AS (SELECT t.*, coalesce(w.{column} * part, 0e0) AS fw FROM t LEFT JOIN w USING (ix, iy)), c AS (SELECT id, sum(fw) AS coef FROM f GROUP BY id) "
        "SELECT ix, iy, round(sum(CASE WHEN coef = 0 THEN 0e0 ELSE n * fw / coef END), 6) AS value FROM f JOIN c USING (id) GROUP BY ix, iy"
    )


@query(_single("weight"))
def disagg_single(spark, sf_dir):
    return rounded(dis.disaggregate(lay.grid(spark), lay.districts(spark, sf_dir), "n", weights(spark, sf_dir)))


@query(_single("west"))
def disagg_zero_weight(spark, sf_dir):
    return rounded(dis.disaggregate(lay.grid(spark), lay.districts(spark, sf_dir), "n", weights(spark, sf_dir), "west"))


_BATCH = (
    f"{_BASE}, f AS (SELECT t.*, coalesce(w.weight, 0e0) * part / sum(part) OVER (PARTITION BY ix, iy) AS weight, coalesce(w.west, 0e0) * part / sum(part) OVER (PARTITION BY ix, iy) AS west "
    "FROM t LEFT JOIN w USING (ix, iy) WHERE part > 0), c AS (SELECT id, sum(part) AS total, max(n) AS src, sum(weight) AS cw, sum(west) AS cv FROM f GROUP BY id) "
)


@query(f"{_BATCH} SELECT ix, iy, round(sum(src * CASE WHEN cw = 0 THEN part / total ELSE weight / cw END), 6) AS weight, round(sum(src * CASE WHEN cv = 0 THEN part / total ELSE west / cv END), 6) AS west FROM f JOIN c USING (id) GROUP BY ix, iy")
def disagg_batch(spark, sf_dir):
    return rounded(dis.disaggregate_batch(lay.grid(spark), lay.districts(spark, sf_dir), "n", weights(spark, sf_dir)))


@query(f"{_BATCH} SELECT id, round(sum(src * CASE WHEN cv = 0 THEN part / total ELSE west / cv END), 4) AS total FROM f JOIN c USING (id) GROUP BY id")
def disagg_batch_zero_fallback(spark, sf_dir):
    """Totals by district again: nothing is lost where all weights are 0."""
    made = dis.disaggregate_batch(lay.grid(spark), lay.districts(spark, sf_dir), "n", weights(spark, sf_dir), ["west"])
    home = F.expr("cast(iy div 4 * 5 + ix div 4 as int)").alias("id")
    return made.groupBy(home).agg(F.round(F.sum("west"), 4).alias("total"))


def _raw(join: str) -> str:
    return f"""WITH {DISTRICTS}, {SITES},
m AS (SELECT d.id AS src, d.n, d.region, s.id AS tgt, CASE WHEN s.id IS NULL THEN 1e0 ELSE coalesce(s.weight, 0e0) END AS wt,
  coalesce(s.x0, d.x0) AS x0, coalesce(s.y0, d.y0) AS y0, coalesce(s.x1, d.x1) AS x1, coalesce(s.y1, d.y1) AS y1,
  CASE WHEN s.id IS NOT NULL THEN {part_sql('d', 's')} END AS part FROM d {join} s ON {touch_sql('d', 's')}),
f AS (SELECT *, CASE WHEN tgt IS NULL THEN 1e0 ELSE coalesce(part / nullif(sum(part) OVER (PARTITION BY x0, y0, x1, y1, tgt IS NULL), 0), 0e0) END AS share FROM m),
r AS (SELECT src, max(n) / CASE WHEN sum(wt * share) = 0 THEN count(*) ELSE sum(wt * share) END AS rn,
  max(CAST(region AS DOUBLE)) / CASE WHEN sum(wt * share) = 0 THEN count(*) ELSE sum(wt * share) END AS rr FROM f GROUP BY src),
o AS (SELECT x0, y0, x1, y1, sum(wt * share * rn) AS n_disag_weight, sum(wt * share * rr) AS region_disag_weight FROM f JOIN r USING (src) GROUP BY x0, y0, x1, y1)
SELECT o.x0, o.y0, o.x1, o.y1, round(n_disag_weight, 6) AS n_disag_weight, round(region_disag_weight, 6) AS region_disag_weight, s.id, round(s.weight, 6) AS weight
FROM o LEFT JOIN s ON s.x0 = o.x0 AND s.y0 = o.y0 AND s.x1 = o.x1 AND s.y1 = o.y1"""


def _raw_query(keep: bool):
    def run(spark, sf_dir):
        made = dis.disaggregate_raw(lay.districts(spark, sf_dir), ["n", "region"], lay.sites(spark, sf_dir), ["weight"], keep)
        b = F.col("geometry.box")
        return made.select(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.round("n_disag_weight", 6).alias("n_disag_weight"), F.round("region_disag_weight", 6).alias("region_disag_weight"), "id", F.round("weight", 6).alias("weight"))

    return run


query(_raw("JOIN"), "disagg_raw")(_raw_query(False))
query(_raw("LEFT JOIN"), "disagg_raw_keep_unweighted")(_raw_query(True))

_NORMAL = """u AS (SELECT from_id, to_id, sum(weight) AS weight FROM c GROUP BY from_id, to_id HAVING sum(weight) > 0),
x AS (SELECT from_id, to_id, weight / sum(weight) OVER (PARTITION BY from_id) AS transfer_weight FROM u)"""
_BY_SITE = f"WITH {DISTRICTS}, {SITES}, {QUARTERS}, c AS (SELECT d.id AS from_id, q.id AS to_id, {part_sql('s', 'd', 'q')} * s.weight AS weight FROM s JOIN d ON {touch_sql('s', 'd')} JOIN q ON {touch_sql('s', 'q')} WHERE s.weight > 0), {_NORMAL}"
_BY_CELL = f"WITH {grid_sql()}, {POINTS}, {DISTRICTS}, {QUARTERS}, {_W}, c AS (SELECT d.id AS from_id, q.id AS to_id, {part_sql('g', 'd', 'q')} * w.weight AS weight FROM g JOIN w USING (ix, iy) JOIN d ON {touch_sql('g', 'd')} JOIN q ON {touch_sql('g', 'q')} WHERE w.weight > 0), {_NORMAL}"


@query(f"{_BY_SITE} SELECT from_id, to_id, round(transfer_weight, 6) AS transfer_weight FROM x")
def transfer_weights(spark, sf_dir):
    made = tra.transfer_weights(lay.districts(spark, sf_dir), "id", lay.quarters(spark), "id", lay.sites(spark, sf_dir))
    return made.select("from_id", "to_id", F.round("transfer_weight", 6).alias("transfer_weight"))


def _by_cell(spark, sf_dir) -> DataFrame:
    from ..functions import geometry as geo

    cells = lay.grid(spark).select("geohash", geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry"))
    return tra.transfer_weights(lay.districts(spark, sf_dir), "id", lay.quarters(spark), "id", cells, "weight", weights(spark, sf_dir))


@query(f"{_BY_CELL} SELECT from_id, to_id, round(transfer_weight, 6) AS transfer_weight FROM x")
def transfer_weights_grid(spark, sf_dir):
    return _by_cell(spark, sf_dir).select("from_id", "to_id", F.round("transfer_weight", 6).alias("transfer_weight"))


@query(f"{_BY_CELL} SELECT q.id, round(sum(d.n * x.transfer_weight), 6) AS n FROM x JOIN d ON d.id = x.from_id JOIN q ON q.id = x.to_id GROUP BY q.id")
def transfer_apply(spark, sf_dir):
    made = tra.apply_transfer(lay.districts(spark, sf_dir), "id", "n", lay.quarters(spark), "id", _by_cell(spark, sf_dir))
    return made.select("id", F.round("n", 6).alias("n"))


def modelled(spark, sf_dir) -> DataFrame:
    """Customers by cell, and the square root of the order weights as a second model."""
    single = dis.disaggregate(lay.grid(spark), lay.districts(spark, sf_dir), "n", weights(spark, sf_dir))
    w = weights(spark, sf_dir).select("geohash", F.sqrt("weight").alias("root"))
    return single.select("geohash", "value").join(w, "geohash", "left")


def truth(spark, sf_dir) -> DataFrame:
    return feat.target(lay.grid(spark), lay.buildings(spark, sf_dir), "id").select("geohash", (F.col("target") / 100000).alias("target"))


_SINGLE = f"""{_BASE}, f AS (SELECT t.*, coalesce(w.weight * part, 0e0) AS fw FROM t LEFT JOIN w USING (ix, iy)), c AS (SELECT id, sum(fw) AS coef FROM f GROUP BY id),
mo AS (SELECT ix, iy, sum(CASE WHEN coef = 0 THEN 0e0 ELSE n * fw / coef END) AS value FROM f JOIN c USING (id) GROUP BY ix, iy),
{BUILDINGS}, tr AS (SELECT g.ix, g.iy, sum(b.id * {part_sql('g', 'b')} / (b.w * b.h)) / 100000 AS target FROM g LEFT JOIN b ON {touch_sql('g', 'b')} GROUP BY g.ix, g.iy),
al AS (SELECT g.ix, g.iy, coalesce(tr.target, 0e0) AS t, coalesce(mo.value, 0e0) AS m, coalesce(sqrt(w.weight), 0e0) AS r FROM g LEFT JOIN tr USING (ix, iy) LEFT JOIN mo USING (ix, iy) LEFT JOIN w USING (ix, iy))"""


def _measures(t: str, m: str, n: str = "count(*)") -> str:
    return (
        f"round(sum({m} - {t}), 4) AS diff, round(sum(abs({m} - {t})), 4) AS tae, round(sum(abs({m} - {t})) / sum({t}), 5) AS rtae, "
        f"round(1 - sum(({m} - {t}) ** 2) / (sum({t} * {t}) - sum({t}) ** 2 / {n}), 5) AS r2, round(sqrt(sum(({m} - {t}) ** 2) / {n}), 5) AS rmse"
    )


def _shown(df: DataFrame, *keep: str) -> DataFrame:
    digits = {"diff": 4, "tae": 4, "rtae": 5, "r2": 5, "rmse": 5}
    return df.select(*keep, *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"WITH {BUILDINGS} SELECT {_measures('t', 'm')} FROM (SELECT CAST(w AS DOUBLE) AS t, CAST(h AS DOUBLE) AS m FROM b)")
def validate_raw(spark, sf_dir):
    b = F.col("geometry.box")
    rows = lay.buildings(spark, sf_dir).select((b["x1"] - b["x0"]).alias("target"), (b["y1"] - b["y0"]).alias("value"))
    return _shown(val.validate_raw(rows))


@query(f"{_SINGLE} SELECT {_measures('t', 'm')} FROM al")
def validate_model(spark, sf_dir):
    return _shown(val.validate_model(lay.grid(spark), truth(spark, sf_dir), modelled(spark, sf_dir)))


@query(f"{_SINGLE} SELECT 'value' AS model, {_measures('t', 'm')} FROM al UNION ALL SELECT 'root' AS model, {_measures('t', 'r')} FROM al")
def validate_array(spark, sf_dir):
    return _shown(val.validate_array(lay.grid(spark), truth(spark, sf_dir), modelled(spark, sf_dir)), "model")


def _level(k: int) -> str:
    side = CELL * k
    coarse = -(-1000 // side)
    last = coarse if coarse * side <= 1000 else coarse - 1
    return (
        f"SELECT {k} AS multiple, {_measures('t', 'm', str((last + 1) ** 2))} FROM (SELECT sum(t) AS t, sum(m) AS m FROM al "
        f"WHERE ix // {k} <= {last} AND iy // {k} <= {last} GROUP BY ix // {k}, iy // {k})"
    )


@query(f"{_SINGLE} {' UNION ALL '.join(map(_level, val.MULTIPLES))}")
def validate_multiscale(spark, sf_dir):
    return _shown(val.validate_multiscale(lay.grid(spark), truth(spark, sf_dir), modelled(spark, sf_dir), area=AREA), "multiple")


_QUANTILES = ", ".join(f"round(quantile_cont(v, {q}), 5) AS {n}" for n, q in val.PERCENTILES.items())


@query(
    f"{_SINGLE}, u AS (SELECT 'modeled' AS kind, m AS v FROM al UNION ALL SELECT 'real', t FROM al UNION ALL SELECT 'residuals', m - t FROM al UNION ALL SELECT 'abs_residuals', abs(m - t) FROM al) "
    f"SELECT kind, round(min(v), 5) AS min, round(max(v), 5) AS max, round(sum(v), 4) AS sum, round(avg(v), 5) AS mean, {_QUANTILES} FROM u GROUP BY kind"
)
def validate_describe(spark, sf_dir):
    both = val.aligned(lay.grid(spark).select("geohash"), truth(spark, sf_dir), modelled(spark, sf_dir), "target", ["value"])
    made = val.describe(both, "_true", "value")
    return made.select("kind", *[F.round(c, 4 if c == "sum" else 5).alias(c) for c in made.columns if c != "kind"])


def _pairs(spark, sf_dir) -> DataFrame:
    o = lay.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("raw"), (F.col("o_totalprice") * 0.5 + F.col("o_custkey") % 1000).alias("known"))


_XY = "xy AS (SELECT o_orderkey AS id, o_totalprice AS raw, o_totalprice * 0.5e0 + o_custkey % 1000 AS known FROM orders)"


@query(f"WITH {_XY} SELECT id, round(greatest(raw * (SELECT sum(known) / sum(raw) FROM xy), 0), 3) AS calibrated FROM xy")
def calibrate_sum(spark, sf_dir):
    return cal.calibrate(_pairs(spark, sf_dir), "raw", "known", "calibrated", "sum").select("id", F.round("calibrated", 3).alias("calibrated"))


@query(f"WITH {_XY}, f AS (SELECT regr_slope(known, raw) AS a, regr_intercept(known, raw) AS b FROM xy) SELECT id, round(greatest(raw * a + b, 0), 3) AS calibrated FROM xy, f")
def calibrate_ols(spark, sf_dir):
    return cal.calibrate(_pairs(spark, sf_dir), "raw", "known", "calibrated", "ols").select("id", F.round("calibrated", 3).alias("calibrated"))


@query()
def calibrate_lad(spark, sf_dir):
    return cal.calibrate(_pairs(spark, sf_dir), "raw", "known", "calibrated", "lad").select("id", F.round("calibrated", 1).alias("calibrated"))


