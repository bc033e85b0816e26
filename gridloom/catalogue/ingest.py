"""Translation, attributes, shapes, dissolving and importers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as att
from ..functions import geometry as geo
from ..functions import project, wkt
from ..functions.translate import Translation
from ..operators import wrangle as wra
from ..sources import layers as imp
from ..sources import osm, raster, tables
from . import layers as lay
from .layers import BUILDINGS, DISTRICTS, touch_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files of this run that all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridloom-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def text_file(spark: SparkSession, name: str, lines: DataFrame) -> str:
    path = scratch(spark, name)
    lines.coalesce(1).write.text(path)
    return path


_BRANDS = {"Brand#1": 1, "Brand#12": 12, "Brand#2": 2}


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def recat_exact(spark, sf_dir):
    made = wra.recategorise(lay.table(spark, sf_dir, "orders"), "o_orderstatus", "code", Translation({"F": 1, "O": 2}, default=None))
    return made.select(F.col("o_orderkey").alias("id"), "code")


@query("SELECT p_partkey AS id, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 1 WHEN starts_with(p_brand, 'Brand#12') THEN 12 WHEN starts_with(p_brand, 'Brand#2') THEN 2 ELSE 0 END AS code FROM part")
def recat_leading(spark, sf_dir):
    made = wra.recategorise(lay.table(spark, sf_dir, "part"), "p_brand", "code", Translation(_BRANDS, leading=True, default=0))
    return made.select(F.col("p_partkey").alias("id"), "code")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'final' ELSE o_orderstatus END AS code FROM orders")
def recat_passthrough(spark, sf_dir):
    made = wra.recategorise(lay.table(spark, sf_dir, "orders"), "o_orderstatus", "code", Translation({"F": "final"}))
    return made.select(F.col("o_orderkey").alias("id"), "code")


def _tagged(spark, sf_dir) -> DataFrame:
    """Events as tagged features: the type of an event and a value with a unit."""
    e = lay.table(spark, sf_dir, "events")
    tags = F.map_filter(
        F.create_map(F.lit("kind"), F.col("event_type"), F.lit("height"), F.when(F.col("event_id") % 3 != 0, F.concat(F.round("value", 1).cast("decimal(20,1)").cast("string"), F.lit(" m"))), F.lit("levels"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 7).cast("string")), F.lit("name"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("n"), F.col("event_id")))),
        lambda k, v: v.isNotNull(),
    )
    return e.select(F.col("event_id").alias("id"), tags.alias("tags"))


_TAGGED = """e AS (SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(round(value, 1) AS DECIMAL(20,1)) AS DOUBLE) END AS height,
  CASE WHEN event_id % 4 = 0 THEN event_id % 7 END AS levels, CASE WHEN event_id % 5 = 0 THEN 'n' || event_id END AS name FROM events)"""


def _attribute(name: str, spec: dict, kind: str, sql: str) -> None:
    def run(spark, sf_dir):
        return att.extract(_tagged(spark, sf_dir), [{"name": "v", "type": kind, **spec}]).select("id", "v")

    query(f"WITH {_TAGGED} {sql}", name)(run)


_attribute("attr_get", {"getter": "height"}, "float", "SELECT id, height AS v FROM e")
_attribute("attr_restrict", {"getter": {"get": "levels"}, "restrict": True}, "int", "SELECT id, levels AS v FROM e WHERE levels IS NOT NULL")
_attribute("attr_gather", {"getter": {"gather": ["levels", "height"]}}, "float", "SELECT id, coalesce(CAST(levels AS DOUBLE), height) AS v FROM e")
_attribute("attr_alternative", {"getter": {"alternative": ["name", {"get": "kind"}]}}, "str", "SELECT id, coalesce(name, kind) AS v FROM e")
_attribute("attr_minmax", {"getter": {"max": ["height", "levels"]}}, "float", "SELECT id, CASE WHEN height IS NULL THEN CAST(levels AS DOUBLE) WHEN levels IS NULL THEN height ELSE greatest(height, levels) END AS v FROM e")
_attribute("attr_switch", {"getter": {"switch": {"key": "kind", "cases": {"click": 1, "view": 2}, "default": 0}}}, "int", "SELECT id, CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS v FROM e")
_attribute("attr_ifpresent", {"getter": {"ifpresent": {"key": "name", "then": "named", "else": "kind"}}}, "str", "SELECT id, CASE WHEN name IS NOT NULL THEN 'named' ELSE kind END AS v FROM e")
_attribute("attr_constant", {"getter": {"constant": "x"}, "selection": {"and": ["name", {"not": ["levels"]}]}}, "str", "SELECT id, CASE WHEN name IS NOT NULL AND levels IS NULL THEN 'x' END AS v FROM e")
_attribute("attr_more_explode", {"getter": {"more": ["kind", "name"]}}, "str", "SELECT id, kind AS v FROM e UNION ALL SELECT id, name FROM e WHERE name IS NOT NULL")


@query("SELECT event_id AS id FROM events WHERE event_type IN ('click', 'purchase') OR event_id % 5 = 0")
def attr_select(spark, sf_dir):
    return _tagged(spark, sf_dir).where(att.selection({"or": [{"kind": ["click", "purchase"]}, "name"]}, F.col("tags"))).select("id")


@query(f"WITH {BUILDINGS} SELECT id, CAST(w * h AS DOUBLE) AS area FROM b")
def shape_area(spark, sf_dir):
    return lay.buildings(spark, sf_dir).select("id", geo.area(F.col("geometry")).alias("area"))


@query(f"WITH {BUILDINGS} SELECT id, round(2 * (w + h) / (3.5449077e0 * sqrt(w * h)), 6) AS perim_index FROM b")
def shape_perim_index(spark, sf_dir):
    made = wra.shape_metrics(lay.buildings(spark, sf_dir), buffers=False)
    return made.select("id", F.round("perim_index", 6).alias("perim_index"))


_K = """k AS (SELECT o_orderkey AS id, CAST(10 + o_orderkey % 60 AS DOUBLE) AS w, CAST(10 + o_custkey % 50 AS DOUBLE) AS h FROM orders)"""


@query(f"WITH {_K} SELECT id, round(w * h * 0.75e0, 6) AS area, round(1 - 0.75e0 / 0.875e0, 6) AS concavity_index, round(3.5449077e0 * sqrt(w * h * 0.75e0) / (w + h + w / 2 + h / 2 + sqrt(w * w / 4 + h * h / 4)), 6) AS detour_index FROM k")
def shape_hull_idx(spark, sf_dir):
    made = wra.shape_metrics(lay.corners(spark, sf_dir), buffers=False)
    return made.select("id", *[F.round(c, 6).alias(c) for c in ("area", "concavity_index", "detour_index")])


@query()
def shape_buffer_idx(spark, sf_dir):
    made = wra.shape_metrics(lay.corners(spark, sf_dir))
    return made.select("id", F.round("fullness_index", 3).alias("fullness_index"), F.round("depth_index", 3).alias("depth_index"))


@query(f"WITH {_K} SELECT id, round(w * h * 0.75e0, 6) AS area, 7 AS points FROM k")
def geom_fix(spark, sf_dir):
    """Rings with a spike and the wrong turn are put right."""
    shapes = lay.corners(spark, sf_dir)
    ring = F.col("geometry.parts")[0][0]
    spiked = F.reverse(F.concat(F.slice(ring, 1, 2), F.array(geo.xy(ring[1]["x"] + 5, ring[1]["y"])), F.slice(ring, 2, F.size(ring) - 1)))
    broken = shapes.select("id", geo.from_parts("Polygon", F.array(F.array(spiked))).alias("geometry"))
    fixed = wra.fix_geometries(broken)
    g = F.col("geometry")
    return fixed.select("id", F.round(geo.area(g), 6).alias("area"), F.size(g["parts"][0][0]).alias("points"))


@query(
    f"WITH RECURSIVE {DISTRICTS}, keep AS (SELECT * FROM d WHERE id % 7 <> 3), e AS (SELECT a.id AS a, b.id AS b FROM keep a JOIN keep b ON a.id <> b.id AND {touch_sql('a', 'b')} "
    "AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0), "
    "r(id, other) AS (SELECT id, id FROM keep UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT id, min(other) AS component FROM r GROUP BY id) "
    "SELECT component, count(*) * 40000e0 AS area FROM c GROUP BY component"
)
def dissolve_components(spark, sf_dir):
    made = wra.dissolve(lay.districts(spark, sf_dir).where("id % 7 <> 3"), "id")
    return made.select("component", geo.area(F.col("geometry")).alias("area"))


def _rings(spark, sf_dir) -> DataFrame:
    """Districts as GeoJSON text."""
    b = F.col("geometry.box")
    corner = lambda x, y: F.array(b[x], b[y])
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    d = lay.districts(spark, sf_dir)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    props = F.struct(F.col("n").cast("string").alias("n"), F.col("region").cast("string").alias("region"))
    return d.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id"), props.alias("properties"), shape.alias("geometry"))).alias("value"))


@query(f"WITH {DISTRICTS} SELECT CAST(id AS VARCHAR) AS id, CAST(CAST(n AS BIGINT) AS VARCHAR) AS n, 40000e0 AS area FROM d")
def src_geojson(spark, sf_dir):
    made = imp.geojson_text(_rings(spark, sf_dir), 0)
    return made.select("id", F.col("properties")["n"].alias("n"), geo.area(F.col("geometry")).alias("area"))


@query(f"WITH {DISTRICTS} SELECT CASE region WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS zone, count(*) AS n FROM d GROUP BY 1")
def src_multi(spark, sf_dir):
    """Two files by one pattern, with a translated property."""
    folder = scratch(spark, "multi")
    rows = _rings(spark, sf_dir)
    rows.repartition(2).write.text(f"{folder}/part.jsonl")
    made = imp.import_many(spark, f"{folder}/*.jsonl", "region", "zone", Translation({"0": "zero", "1": "one"}, default="other"))
    return made.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BUILDINGS} SELECT id, x0, y0, x1, y1, CAST(w * h AS DOUBLE) AS area FROM b")
def src_wkt(spark, sf_dir):
    """Boxes to text and back."""
    made = lay.buildings(spark, sf_dir).select("id", wkt.from_wkt(wkt.to_wkt(F.col("geometry"))).alias("geometry"))
    return made.select("id", "geometry.box.*", geo.area(F.col("geometry")).alias("area"))


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def src_csv_sniff(spark, sf_dir):
    c = lay.table(spark, sf_dir, "customer")
    lines = c.select(F.concat_ws(";", "c_custkey", "c_name", F.col("c_acctbal").cast("decimal(20,4)")).alias("value"))
    head = spark.createDataFrame([("id;name;balance",)], "value string")
    path = text_file(spark, "csv", head.unionAll(lines))
    return tables.read_table(spark, path).select("id", "name", F.round("balance", 2).alias("balance"))


def _raster(spark) -> DataFrame:
    """Cells of a raster, as its reader gives them."""
    cells = spark.range(40 * 30).select((F.col("id") % 40).cast("int").alias("i"), (F.col("id") / 40).cast("int").alias("j"))
    value = ((F.col("i") * 7 + F.col("j") * 13) % 17).cast("double")
    return cells.select(F.lit("r").alias("file"), "i", "j", value.alias("value"), F.lit(0.0).alias("x"), F.lit(750.0).alias("y"), F.lit(25.0).alias("size")).where("value <> 0")


_RASTER = "r AS (SELECT k % 40 AS i, k // 40 AS j, CAST(((k % 40) * 7 + (k // 40) * 13) % 17 AS DOUBLE) AS band_1 FROM range(1200) t(k) WHERE ((k % 40) * 7 + (k // 40) * 13) % 17 <> 0)"


@query(f"WITH {_RASTER} SELECT band_1, i * 25e0 AS x0, 725 - j * 25e0 AS y0, i * 25e0 + 25 AS x1, 750 - j * 25e0 AS y1 FROM r")
def raster_cells(spark, sf_dir):
    return raster.cells_to_layer(_raster(spark)).select("band_1", "geometry.box.*")


@query(f"WITH {_RASTER} SELECT CAST(band_1 AS INTEGER) AS band_1, i * 25 + 12.5e0 AS x, 750 - j * 25 - 12.5e0 AS y FROM r WHERE i * 25 <= 500")
def raster_points(spark, sf_dir):
    made = raster.cells_to_layer(_raster(spark), points=True, area=(0.0, 0.0, 500.0, 750.0), whole=True)
    return made.select("band_1", F.col("geometry.box.x0").alias("x"), F.col("geometry.box.y0").alias("y"))


@query("SELECT i, j, CAST((i * 3 + j) % 5 AS DOUBLE) AS value FROM range(6) a(i), range(4) b(j) WHERE (i * 3 + j) % 5 <> 4")
def src_ascii_grid(spark, sf_dir):
    rows = [" ".join(str((i * 3 + j) % 5) for i in range(6)) for j in range(4)]
    text = "\n".join(["ncols 6", "nrows 4", "xllcorner 0", "yllcorner 0", "cellsize 10", "NODATA_value 4", *rows])
    path = text_file(spark, "grid", spark.createDataFrame([(text,)], "value string"))
    return raster.read_cells(spark, path).select("i", "j", "value")


WAYS = (4326, 3857, 32632)


@query(f"WITH {DISTRICTS} SELECT id, round(x0, 3) AS x, round(y0, 3) AS y FROM d")
def project_round_trip(spark, sf_dir):
    """Places go to degrees and back in three reference systems; the mean is the place itself."""
    b = F.col("geometry.box")
    x, y = b["x0"] + 4300000, b["y0"] + 3200000
    df = lay.districts(spark, sf_dir).select("id", *[project.moved(x, y, 3035, s).alias(f"w{s}") for s in WAYS])
    df = df.select("id", *[project.moved(F.col(f"w{s}.x"), F.col(f"w{s}.y"), s, 3035).alias(f"w{s}") for s in WAYS])
    mean = lambda k, less: F.round(sum(F.col(f"w{s}.{k}") for s in WAYS) / len(WAYS) - less, 3).alias(k)
    return df.select("id", mean("x", 4300000), mean("y", 3200000))


OSM = """<osm>
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="4"/><node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
<node id="5" lat="1" lon="1"/><node id="6" lat="1" lon="2"/><node id="7" lat="2" lon="2"/><node id="8" lat="2" lon="1"/>
<node id="9" lat="9" lon="9"><tag k="amenity" v="cafe"/><tag k="name" v="A"/></node>
<node id="10" lat="9" lon="8"><tag k="amenity" v="bar"/><tag k="disused" v="yes"/></node>
<way id="20"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="landuse" v="forest"/><tag k="note" v="x"/></way>
<way id="21"><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="landuse" v="forest"/></way>
<way id="22"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="8"/><nd ref="5"/><tag k="building" v="yes"/><tag k="height" v="12 m"/></way>
<way id="23"><nd ref="1"/><nd ref="9"/><tag k="highway" v="road"/></way>
<way id="24"><nd ref="99"/><tag k="highway" v="lost"/></way>
<node id="50" lat="20" lon="20"/><node id="51" lat="20" lon="26"/><node id="52" lat="26" lon="26"/><node id="53" lat="26" lon="20"/>
<way id="60"><nd ref="50"/><nd ref="51"/><nd ref="52"/><nd ref="53"/><nd ref="50"/><tag k="landuse" v="forest"/><tag k="name" v="W"/></way>
<way id="61"><nd ref="50"/><nd ref="51"/><nd ref="52"/><nd ref="50"/><tag k="highway" v="pedestrian"/><tag k="area" v="yes"/></way>
<way id="62"><nd ref="50"/><nd ref="51"/><nd ref="50"/><tag k="natural" v="tree_row"/></way>
<way id="63"><nd ref="50"/><nd ref="51"/><nd ref="52"/><nd ref="50"/><tag k="highway" v="service"/><tag k="area" v="yes"/></way>
<relation id="31"><member type="way" ref="60" role="outer"/><tag k="type" v="multipolygon"/><tag k="name" v="N"/></relation>
<relation id="30"><member type="way" ref="20" role="outer"/><member type="way" ref="21" role="outer"/><member type="way" ref="22" role="inner"/><tag k="type" v="multipolygon"/></relation>
</osm>"""


def _osm(spark) -> dict[str, DataFrame]:
    return osm.read(spark, text_file(spark, "osm", spark.createDataFrame([(OSM,)], "value string")))


@query("SELECT * FROM (VALUES ('node/9', 9e0, 9e0, 'cafe')) t(id, lon, lat, amenity)")
def osm_nodes(spark, sf_dir):
    return osm.node_features(_osm(spark)).select("id", F.col("geometry.box.x0").alias("lon"), F.col("geometry.box.y0").alias("lat"), F.col("tags")["amenity"].alias("amenity"))


@query("SELECT * FROM (VALUES ('way/20', 'LineString', 'note'), ('way/22', 'Polygon', 'building,height'), ('way/23', 'LineString', 'highway'), ('way/60', 'Polygon', 'name'), ('way/61', 'LineString', 'area,highway'), ('way/63', 'Polygon', 'area,highway')) t(id, type, tags)")
def osm_ways(spark, sf_dir):
    store = _osm(spark)
    _, used = osm.relation_features(store)
    return osm.way_features(store, used).select("id", F.col("geometry.type").alias("type"), F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tags"))


@query("SELECT * FROM (VALUES ('rel/30', 15e0, 'forest', NULL), ('rel/31', 36e0, 'forest', 'N')) t(id, area, landuse, name)")
def osm_relations(spark, sf_dir):
    """Relation 30 takes all tags its outer ways share; 31 has a name of its own and takes the other tag only."""
    made, _ = osm.relation_features(_osm(spark))
    return made.select("id", geo.area(F.col("geometry")).alias("area"), F.col("tags")["landuse"].alias("landuse"), F.col("tags")["name"].alias("name"))


@query("SELECT * FROM (VALUES ('building', 'way/22', 12e0), ('place', 'node/9', NULL), ('place', 'way/22', NULL)) t(layer, id, height)")
def osm_extract(spark, sf_dir):
    config = {
        "layers": {
            "building": {"geometry": "polygon", "selector": "building", "attributes": [{"name": "height", "type": "float", "getter": "height"}]},
            "place": {"geometry": "point", "input-geometries": ["point", "polygon"], "selector": {"or": ["amenity", "building"]}},
        }
    }
    made = osm.extract_layers(osm.features(_osm(spark)), config)
    rows = [df.select(F.lit(n).alias("layer"), "id", (F.col("height") if "height" in df.columns else F.lit(None).cast("double")).alias("height")) for n, df in sorted(made.items())]
    return rows[0].unionByName(rows[1])
