"""Grid, features, conditions, targets, neighbourhoods, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import consolidate as con
from ..operators import features as feat
from ..operators import grid as gr
from ..operators.neighbourhood import kernel, neighbourhood, suffix
from ..plans.tasks import feature_tables
from . import layers as lay
from .layers import BUILDINGS, CELL, DISTRICTS, LAST, LINES, POINTS, SITES, grid_sql, part_sql, touch_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Cell indices, and all other numbers rounded."""
    kinds = dict(df.dtypes)
    return df.select(*keep, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in (*keep, "geohash")])


@query(f"WITH {grid_sql()} SELECT ix, iy, x0, y0, x1, y1 FROM g")
def grid_make(spark, sf_dir):
    return lay.grid(spark).select("ix", "iy", "x0", "y0", "x1", "y1")


@query(f"WITH {grid_sql(70, off=30)} SELECT ix, iy, x0, y0, x1, y1, inside FROM g")
def grid_offset(spark, sf_dir):
    return lay.grid(spark, 70, xoffset=30, yoffset=30).select("ix", "iy", "x0", "y0", "x1", "y1", "inside")


@query(f"WITH {grid_sql()} SELECT inside, count(*) AS cells FROM g GROUP BY inside")
def grid_inside(spark, sf_dir):
    area = gr.extent(lay.districts(spark, sf_dir))
    return lay.grid(spark, inside=gr.inside_extent(area)).groupBy("inside").agg(F.count(F.lit(1)).alias("cells"))


_HASH, _AXES = lay.geohash_sql("lon", "lat")
_HASH_SQL = f"""h AS (SELECT *, {_HASH} AS geohash FROM (SELECT *, {_AXES[0]} AS xx, {_AXES[1]} AS yy FROM (SELECT *, (x0 + x1) / 2 / 100000e0 + 14e0 AS lon, (y0 + y1) / 2 / 100000e0 + 50e0 AS lat FROM g)))""".replace(".0e0", "e0")


@query(f"WITH {grid_sql()}, {_HASH_SQL} SELECT ix, iy, geohash FROM h")
def grid_geohash(spark, sf_dir):
    return lay.grid(spark).select("ix", "iy", "geohash")


@query(f"WITH {BUILDINGS} SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b")
def extent_bbox(spark, sf_dir):
    return gr.bounds(lay.buildings(spark, sf_dir))


@query("SELECT 0e0 AS x0, 0e0 AS y0, 1000e0 AS x1, 1000e0 AS y1, 1000000e0 AS area, 1 AS parts")
def extent_union(spark, sf_dir):
    e = gr.extent(lay.districts(spark, sf_dir))
    return e.select("x0", "y0", "x1", "y1", geo.area(F.col("geometry")).alias("area"), F.size("geometry.parts").alias("parts"))


@query(f"WITH {BUILDINGS} SELECT id, x0, y0 FROM b WHERE x0 <= 400 AND x1 >= 100 AND y0 <= 300 AND y1 >= 200")
def extent_clip(spark, sf_dir):
    cut = gr.clip(lay.buildings(spark, sf_dir), (100.0, 200.0, 400.0, 300.0))
    return cut.select("id", F.col("geometry.box.x0").alias("x0"), F.col("geometry.box.y0").alias("y0"))


_OVER_B = f"o AS (SELECT g.ix, g.iy, b.*, {part_sql('g', 'b')} AS part, CAST(w * h AS DOUBLE) AS size FROM g LEFT JOIN b ON {touch_sql('g', 'b')})"
_WITH_B = f"WITH {grid_sql()}, {BUILDINGS}, {_OVER_B}"
_OVER_P = "o AS (SELECT g.ix, g.iy, p.* FROM g LEFT JOIN p ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1)"
_WITH_P = f"WITH {grid_sql()}, {POINTS}, {_OVER_P}"
_AREA = float(CELL * CELL)


def _by_case(expression: str, name: str, values: tuple[str, ...], digits: int = 6) -> str:
    """Columns of a category; {v} in the expression is its value."""
    return ", ".join(f"round({expression.replace('{v}', v)}, {digits}) AS {name}_cat_{v}" for v in values)


@query(f"{_WITH_P} SELECT ix, iy, round(count(*) / sum({_AREA}e0), 9) AS dens FROM o GROUP BY ix, iy".replace(".0e0", "e0"))
def feat_dens(spark, sf_dir):
    return rounded(feat.calculate(lay.grid(spark), lay.points(spark, sf_dir), "dens"), 9)


_CASE_P = ("A", "N", "R")
_CASE_B = ("F", "O", "P")
_NUMBER = f"CAST({int(_AREA)} AS DOUBLE)"


@query(f"{_WITH_P} SELECT ix, iy, {_by_case(f'''sum(CASE WHEN cat = '{{v}}' THEN 1e0 ELSE 0e0 END) / sum({_NUMBER})''', 'dens', _CASE_P, 9)} FROM o GROUP BY ix, iy")
def feat_dens_case(spark, sf_dir):
    return rounded(feat.calculate(lay.grid(spark), lay.points(spark, sf_dir), "dens", case="cat"), 9)


@query(f"{_WITH_P} SELECT ix, iy, round(count(val) / {_NUMBER}, 6) AS dens_true FROM o GROUP BY ix, iy")
def feat_dens_true(spark, sf_dir):
    return rounded(feat.feature_density(lay.grid(spark), lay.points(spark, sf_dir)))


_CUT = """c AS (SELECT *, greatest(0e0, tx0, ty0) AS t0, least(1e0, tx1, ty1) AS t1 FROM (SELECT g.ix, g.iy, l.*, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS size,
  (g.x0 - xa) / (xb - xa) AS tx0, (g.x1 - xa) / (xb - xa) AS tx1, (g.y0 - ya) / (yb - ya) AS ty0, (g.y1 - ya) / (yb - ya) AS ty1
  FROM g, l) WHERE greatest(0e0, tx0, ty0) <= least(1e0, tx1, ty1)),
o AS (SELECT g.ix, g.iy, c.cat, (t1 - t0) * size AS run FROM g LEFT JOIN c ON c.ix = g.ix AND c.iy = g.iy)"""
_WITH_L = f"WITH {grid_sql()}, {LINES}, {_CUT}"


@query(f"{_WITH_L} SELECT ix, iy, round(sum(run) / sum({_NUMBER}), 7) AS len FROM o GROUP BY ix, iy")
def feat_len(spark, sf_dir):
    return rounded(feat.calculate(lay.grid(spark), lay.lines(spark, sf_dir), "len"), 7)


_BRAND = "list_sort(list(DISTINCT cat))[1]"


@query(f"{_WITH_L} SELECT ix, iy, round(sum(CASE WHEN cat = (SELECT min(cat) FROM l) THEN run ELSE 0e0 END) / sum({_NUMBER}), 7) AS len_first FROM o GROUP BY ix, iy")
def feat_len_case(spark, sf_dir):
    made = rounded(feat.calculate(lay.grid(spark), lay.lines(spark, sf_dir), "len", case="cat"), 7)
    return made.select("ix", "iy", F.col(f"`{made.columns[2]}`").alias("len_first"))


@query(f"{_WITH_L} SELECT ix, iy, round(coalesce(sum(run), 0e0) / {_NUMBER}, 6) AS len_true FROM o GROUP BY ix, iy")
def feat_len_true(spark, sf_dir):
    return rounded(feat.line_density(lay.grid(spark), lay.lines(spark, sf_dir)))


#: Method -> numerator, divisor.
_METHODS = {
    "cov": ("part * CASE WHEN id IS NOT NULL THEN 1 END", f"max({_NUMBER})"),
    "sum": ("val", "1e0"),
    "avg": ("val", "count(*)"),
    "wavg": ("val * size", "sum(size)"),
    "dsum": ("val * part / size", "1e0"),
    "davg": ("val * part", "sum(CASE WHEN id IS NOT NULL THEN part END)"),
}


def _plain(num: str, den: str) -> str:
    return f"round(CASE WHEN {den} = 0 THEN 0e0 ELSE sum({num}) / {den} END, 6)"


def _cased(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0e0 ELSE sum(CASE WHEN cat = '{{v}}' THEN {num} ELSE 0e0 END) / {den} END"


def _polygon_queries() -> None:
    for method, (num, den) in _METHODS.items():
        source = None if method == "cov" else "val"
        name = method if source is None else f"{method}_val"

        def plain(spark, sf_dir, method=method, source=source):
            return rounded(feat.calculate(lay.grid(spark), lay.buildings(spark, sf_dir), method, source))

        def cased(spark, sf_dir, method=method, source=source):
            return rounded(feat.calculate(lay.grid(spark), lay.buildings(spark, sf_dir), method, source, "cat"))

        query(f"{_WITH_B} SELECT ix, iy, {_plain(num, den)} AS {name} FROM o GROUP BY ix, iy", f"feat_{method}")(plain)
        query(f"{_WITH_B} SELECT ix, iy, {_by_case(_cased(num, den), name, _CASE_B)} FROM o GROUP BY ix, iy", f"feat_{method}_case")(cased)


_polygon_queries()


@query(f"{_WITH_B} SELECT ix, iy, {_plain(*_METHODS['cov'])} AS cov, {_plain(*_METHODS['dsum'])} AS dsum_val, {_plain(*_METHODS['avg'])} AS avg_val FROM o GROUP BY ix, iy")
def feat_multi_method(spark, sf_dir):
    return rounded(feat.calculate(lay.grid(spark), lay.buildings(spark, sf_dir), ["cov", "dsum", "avg"], "val"))


@query(
    f"WITH {grid_sql()}, {BUILDINGS}, {_OVER_B}, {POINTS}, op AS (SELECT g.ix, g.iy, p.* FROM g LEFT JOIN p ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1), "
    f"fb AS (SELECT ix, iy, {_plain(*_METHODS['cov'])} AS building_cov FROM o GROUP BY ix, iy), "
    f"fc AS (SELECT ix, iy, {_by_case(_cased(*_METHODS['cov']), 'building_1_cov', _CASE_B)} FROM o GROUP BY ix, iy), "
    "fp AS (SELECT ix, iy, round(sum(val), 6) AS poi_sum_val, round(sum(val) / count(*), 6) AS poi_avg_val FROM op GROUP BY ix, iy) "
    "SELECT ix, iy, building_cov, building_1_cov_cat_F, building_1_cov_cat_O, building_1_cov_cat_P, poi_sum_val, poi_avg_val, true AS condition FROM fb JOIN fc USING (ix, iy) JOIN fp USING (ix, iy)"
)
def feat_by_file(spark, sf_dir):
    tasks = [{"table": "building", "method": "cov"}, {"table": "building", "method": "cov", "case": "cat"}, {"table": "poi", "method": ["sum", "avg"], "source": "val"}]
    cells = lay.grid(spark)
    tables = feature_tables(cells, {"building": lay.buildings(spark, sf_dir), "poi": lay.points(spark, sf_dir)}, tasks)
    return rounded(con.consolidate(tables).join(cells.select("geohash", "ix", "iy"), "geohash"))


#: Area of an L in a cell: its box less the quarter that is cut out.
_L = f"""k AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 900 AS DOUBLE) AS x0, CAST((o_custkey * 104729) % 900 AS DOUBLE) AS y0, CAST(10 + o_orderkey % 60 AS DOUBLE) AS w, CAST(10 + o_custkey % 50 AS DOUBLE) AS h FROM orders),
low AS (SELECT id, x0, y0, x0 + w AS x1, y0 + h / 2 AS y1 FROM k), up AS (SELECT id, x0, y0 + h / 2 AS y0, x0 + w / 2 AS x1, y0 + h AS y1 FROM k), both_parts AS (SELECT * FROM low UNION ALL SELECT * FROM up)"""


@query(f"WITH {grid_sql()}, {_L} SELECT g.ix, g.iy, round(sum(CASE WHEN r.id IS NOT NULL THEN {part_sql('g', 'r')} END) / {_NUMBER}, 6) AS cov FROM g LEFT JOIN both_parts r ON {touch_sql('g', 'r')} GROUP BY g.ix, g.iy")
def feat_cov_polygon(spark, sf_dir):
    return rounded(feat.calculate(lay.grid(spark), lay.corners(spark, sf_dir), "cov"))


@query(f"{_WITH_B} SELECT ix, iy, bool_or(coalesce(val > 300000 AND cat = 'O', false)) AS condition FROM o GROUP BY ix, iy")
def condition_expr(spark, sf_dir):
    return feat.condition(lay.grid(spark), lay.buildings(spark, sf_dir), "val > 300000 AND cat = 'O'").select("ix", "iy", "condition")


@query(f"WITH {grid_sql()} SELECT ix, iy, true AS condition FROM g")
def condition_default(spark, sf_dir):
    return feat.condition(lay.grid(spark), lay.buildings(spark, sf_dir)).select("ix", "iy", "condition")


def _targets() -> None:
    made = {
        "target_point_sum": (lay.points, False, f"{_WITH_P} SELECT ix, iy, round(sum(val), 6) AS target FROM o GROUP BY ix, iy"),
        "target_point_avg": (lay.points, True, f"{_WITH_P} SELECT ix, iy, round(sum(val) / count(*), 6) AS target FROM o GROUP BY ix, iy"),
        "target_poly_dsum": (lay.buildings, False, f"{_WITH_B} SELECT ix, iy, {_plain(*_METHODS['dsum'])} AS target FROM o GROUP BY ix, iy"),
        "target_poly_davg": (lay.buildings, True, f"{_WITH_B} SELECT ix, iy, {_plain(*_METHODS['davg'])} AS target FROM o GROUP BY ix, iy"),
    }
    for name, (layer, relative, sql) in made.items():

        def run(spark, sf_dir, layer=layer, relative=relative):
            return rounded(feat.target(lay.grid(spark), layer(spark, sf_dir), "val", relative))

        query(sql, name)(run)


_targets()


def sparse_feature(spark, sf_dir) -> DataFrame:
    """A feature with empty cells."""
    return feat.calculate(lay.grid(spark), lay.sites(spark, sf_dir), "sum", "weight")


_SPARSE = f"WITH {grid_sql()}, {SITES}, f AS (SELECT g.ix, g.iy, sum(s.weight) AS v FROM g LEFT JOIN s ON {touch_sql('g', 's')} GROUP BY g.ix, g.iy)"


def _neighbourhoods() -> None:
    for sigma in (0.5, 1.0, 2.0):
        rows = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in kernel(sigma))
        name = f"neigh_{suffix(sigma)}"
        sql = (
            f"{_SPARSE}, k(d, w) AS (VALUES {rows}), "
            f"a AS (SELECT t.i AS ix, f.iy, sum(f.v * k.w) AS n, sum(k.w) AS m FROM range({LAST + 1}) t(i), k, f WHERE f.ix = least(greatest(t.i + k.d, 0), {LAST}) AND f.v IS NOT NULL GROUP BY t.i, f.iy), "
            f"b AS (SELECT a.ix, t.i AS iy, sum(a.n * k.w) AS n, sum(a.m * k.w) AS m FROM range({LAST + 1}) t(i), k, a WHERE a.iy = least(greatest(t.i + k.d, 0), {LAST}) GROUP BY a.ix, t.i) "
            f"SELECT f.ix, f.iy, round(CASE WHEN f.v IS NOT NULL THEN b.n / b.m END, 5) AS {name} FROM f LEFT JOIN b ON b.ix = f.ix AND b.iy = f.iy"
        )

        def run(spark, sf_dir, sigma=sigma):
            return rounded(neighbourhood(sparse_feature(spark, sf_dir), ["sum_weight"], [sigma])["sum_weight"], 5)

        query(sql, f"neigh_gauss_{suffix(sigma)}")(run)


_neighbourhoods()


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    g = lay.grid(spark)
    return {"feat_building": feat.calculate(g, lay.buildings(spark, sf_dir), "cov"), "feat_poi": feat.calculate(g, lay.points(spark, sf_dir), "sum", "val"), "feat_neigh_site_sum": neighbourhood(sparse_feature(spark, sf_dir), ["sum_weight"], [1.0])["sum_weight"]}


def wide(spark, sf_dir) -> DataFrame:
    cond = feat.condition(lay.grid(spark), lay.buildings(spark, sf_dir), "val > 300000 AND cat = 'O'")
    return con.consolidate({k: v for k, v in tables(spark, sf_dir).items() if "neigh" not in k}, cond)


def _placed(df: DataFrame, spark, digits: int = 6) -> DataFrame:
    return rounded(df.join(lay.grid(spark).select("geohash", "ix", "iy"), "geohash"), digits)


_WIDE = f"""WITH {grid_sql()}, {BUILDINGS}, {_OVER_B}, {POINTS}, op AS (SELECT g.ix, g.iy, p.* FROM g LEFT JOIN p ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1),
fb AS (SELECT ix, iy, {_plain(*_METHODS['cov'])} AS building_cov, bool_or(coalesce(val > 300000 AND cat = 'O', false)) AS condition FROM o GROUP BY ix, iy),
fp AS (SELECT ix, iy, round(sum(val), 6) AS poi_sum_val FROM op GROUP BY ix, iy), wide AS (SELECT * FROM fb JOIN fp USING (ix, iy))"""


@query(f"{_WIDE} SELECT ix, iy, building_cov, poi_sum_val, condition FROM wide")
def consolidate(spark, sf_dir):
    return _placed(wide(spark, sf_dir), spark)


@query(f"{_WIDE} SELECT ix, iy, building_cov, poi_sum_val, true AS condition FROM wide")
def consolidate_default_condition(spark, sf_dir):
    return _placed(con.consolidate({k: v for k, v in tables(spark, sf_dir).items() if "neigh" not in k}), spark)


@query("SELECT * FROM (VALUES ('feat_building', 'cov', 'feature'), ('feat_poi', 'sum_val', 'feature'), ('feat_neigh_site_sum', 'neigh_1', 'neighbourhood')) t(\"table\", \"column\", kind)")
def feature_list(spark, sf_dir):
    return con.feature_list(tables(spark, sf_dir), spark)


def _choices() -> None:
    for name, invert, column in (("select_regex", False, "building_cov"), ("select_regex_invert", True, "poi_sum_val")):

        def run(spark, sf_dir, invert=invert):
            w = wide(spark, sf_dir)
            return _placed(w.select("geohash", *con.select_features(w, "building_.*", invert)), spark)

        query(f"{_WIDE} SELECT ix, iy, {column} FROM wide", name)(run)


_choices()


@query(f"{_WIDE} SELECT ix, iy, building_cov, poi_sum_val, condition FROM wide WHERE ix < {LAST} AND iy < {LAST}")
def filter_inside(spark, sf_dir):
    return _placed(con.inside_only(wide(spark, sf_dir), lay.grid(spark)), spark)


@query(f"{_WIDE} SELECT ix, iy, building_cov FROM wide WHERE condition")
def filter_condition(spark, sf_dir):
    w = wide(spark, sf_dir)
    return _placed(con.condition_only(w, w).select("geohash", "building_cov"), spark)


@query(f"{_WIDE} SELECT ix, iy, coalesce(building_cov, 0e0) AS building_cov, 0e0 AS missing FROM wide")
def impute_missing(spark, sf_dir):
    return _placed(con.with_features(wide(spark, sf_dir), ["building_cov", "missing"]), spark)


@query(
    f"WITH {grid_sql()}, {SITES}, {DISTRICTS}, f AS (SELECT g.ix, g.iy, g.x0, sum(s.weight) AS v FROM g LEFT JOIN s ON {touch_sql('g', 's')} GROUP BY g.ix, g.iy, g.x0) "
    "SELECT ix, iy, round(v, 6) AS a, CASE WHEN ix < 10 THEN 1e0 END AS b, CASE WHEN ix >= 10 THEN 2e0 END AS c, true AS condition FROM f"
)
def merge_schemas(spark, sf_dir):
    f = sparse_feature(spark, sf_dir).select("geohash", F.col("sum_weight").alias("a"), "ix", F.lit(True).alias("condition"))
    merged = con.merge_schemas([f.where("ix < 10").drop("ix").withColumn("b", F.lit(1.0)), f.where("ix >= 10").drop("ix").withColumn("c", F.lit(2.0))])
    return _placed(merged, spark)


@query()
def subsample_fraction(spark, sf_dir):
    return _placed(con.subsample(wide(spark, sf_dir), 0.25, 1), spark)
