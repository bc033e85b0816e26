"""OpenStreetMap XML as layers declared by a JSON configuration.

Nodes, ways and relations are read as three tables by Spark's XML source; references become equi-joins, and rings are
put together way by way and relation by relation.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, kernels
from ..functions import geometry as geo
from ..functions.wkt import of_shape

_TAG = "tag array<struct<_k:string,_v:string>>"
NODE = f"_id long, _lat double, _lon double, {_TAG}"
WAY = f"_id long, nd array<struct<_ref:long>>, {_TAG}"
RELATION = f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}"
#: Relations that are areas, tags that rule a feature out (fixed values of the format).
AREAS = ("boundary", "multipolygon")
FORBIDDEN = {"disused": "yes"}


def _tags(column: str = "tag") -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(F.coalesce(column, F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: t["_k"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(column, lambda t: t["_k"] == k), -1)["_v"].alias("value"))))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """node (id, lon, lat, tags), way (id, refs, tags), relation (id, members, tags). Compressed files are read as they are."""
    table = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return {
        "node": table("node", NODE).select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags")),
        "way": table("way", WAY).select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags().alias("tags")),
        "relation": table("relation", RELATION).select(F.col("_id").alias("id"), "member", _tags().alias("tags")),
    }


def _usable(tags: Column) -> Column:
    bad = F.lit(False)
    for k, v in FORBIDDEN.items():
        bad = bad | F.coalesce(attributes.tag(tags, k) == v, F.lit(False))
    return ~bad & (F.size(tags) > 0)


def way_lines(store: dict[str, DataFrame]) -> DataFrame:
    """id, tags and points of each way, in order; nodes that are missing are left out, and ways without any."""
    refs = store["way"].select("id", F.posexplode("refs").alias("pos", "node"))
    placed = refs.join(store["node"].select(F.col("id").alias("node"), "lon", "lat"), "node")
    points = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: geo.xy(p["lon"], p["lat"])).alias("points"))
    return store["way"].select("id", "tags").join(points, "id")


def is_area(tags: Column, points: Column) -> Column:
    """Whether a way is closed and stands for an area.

    With the tag area it does, unless that is no or the way is a pedestrian highway; without it highways, barriers and
    junctions are lines.
    """
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    has = lambda k: attributes.tag(tags, k).isNotNull()
    said = attributes.tag(tags, "area")
    walk = F.coalesce(attributes.tag(tags, "highway") == "pedestrian", F.lit(False))
    return closed & F.when(said.isNotNull(), (said != "no") & ~walk).otherwise(~(has("highway") | has("barrier") | has("junction")))


def node_features(store: dict[str, DataFrame]) -> DataFrame:
    return store["node"].where(_usable(F.col("tags"))).select(F.concat(F.lit("node/"), "id").alias("id"), "tags", geo.point(F.col("lon"), F.col("lat"), 4326).alias("geometry"))


def relation_features(store: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Area relations as polygons; and (way, key): tags of their outer ways that are a relation's from now on.

    A relation takes the tags that all its outer ways share, as far as it has none of that name itself; its type is left
    out. Only what it has taken goes from the ways.
    """
    chosen = store["relation"].where(attributes.tag(F.col("tags"), "type").isin(*AREAS))
    members = chosen.select("id", F.col("tags").alias("own"), F.posexplode("member").alias("pos", "m")).where("m._type = 'way'")
    members = members.select("id", "own", "pos", F.col("m._ref").alias("way"), (F.col("m._role") == "inner").alias("inner"))
    lines = way_lines(store).select(F.col("id").alias("way"), "tags", "points")
    met = members.join(lines, "way")
    rows = met.groupBy("id").agg(
        F.first("own").alias("own"),
        F.array_sort(F.collect_list(F.struct("pos", "inner", "points"))).alias("ways"),
        F.collect_list(F.when(~F.col("inner"), F.map_entries("tags"))).alias("outer"),
    )
    shared = F.map_from_entries(F.aggregate(F.slice("outer", 2, F.greatest(F.size("outer") - 1, F.lit(0))), F.element_at("outer", 1), lambda a, b: F.array_intersect(a, b)))
    taken = F.when(F.size("outer") > 0, F.map_filter(shared, lambda k, v: ~F.map_contains_key("own", k))).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    rows = rows.withColumn("taken", taken).withColumn("tags", F.map_filter(F.map_concat("own", "taken"), lambda k, v: k != "type"))

    @F.pandas_udf(f"struct<type:string,parts:{geo.PARTS}>")
    def rings(ways: pd.Series) -> pd.DataFrame:
        out = []
        for own in ways:
            lines = {False: [], True: []}
            for w in own:
                lines[bool(w["inner"])].append([(p["x"], p["y"]) for p in w["points"]])
            made = kernels.assemble(kernels.join_lines(lines[False]), kernels.join_lines(lines[True]))
            out.append({"type": "MultiPolygon" if made else None, "parts": kernels.as_points(made) if made else None})
        return pd.DataFrame(out, columns=["type", "parts"])

    made = rows.select("id", "tags", of_shape(rings("ways"), 4326).alias("geometry")).where(F.col("geometry").isNotNull() & _usable(F.col("tags")))
    used = met.join(rows.select("id", "taken"), "id").where(~F.col("inner")).select("way", F.explode(F.map_keys("taken")).alias("key")).distinct()
    return made.select(F.concat(F.lit("rel/"), "id").alias("id"), "tags", "geometry"), used


def way_features(store: dict[str, DataFrame], used: DataFrame) -> DataFrame:
    """Ways as polygons or lines, without the tags that a relation has taken from them.

    Ways of one point and areas of three points or fewer have no shape.
    """
    taken = used.groupBy("way").agg(F.collect_set("key").alias("taken"))
    rows = way_lines(store).join(taken, F.col("id") == F.col("way"), "left")
    tags = F.when(F.col("taken").isNull(), F.col("tags")).otherwise(F.map_filter("tags", lambda k, v: ~F.array_contains("taken", k)))
    rows = rows.withColumn("tags", tags).where(_usable(F.col("tags")) & (F.size("points") > 1))
    rows = rows.where(~is_area(F.col("tags"), F.col("points")) | (F.size("points") > 3))
    ring = F.array(F.array("points"))
    shape = F.when(is_area(F.col("tags"), F.col("points")), geo.from_parts("Polygon", ring, 4326)).otherwise(geo.from_parts("LineString", ring, 4326))
    return rows.select(F.concat(F.lit("way/"), "id").alias("id"), "tags", shape.alias("geometry"))


def features(store: dict[str, DataFrame]) -> DataFrame:
    """All tagged nodes, relations and ways: id, tags, geometry."""
    areas, used = relation_features(store)
    return node_features(store).unionByName(areas).unionByName(way_features(store, used))


#: Which geometry types a declared input is.
INPUTS = {"point": ("Point",), "line": ("LineString", "MultiLineString"), "polygon": ("Polygon", "MultiPolygon")}


def extract_layers(found: DataFrame, config: dict, area: tuple[float, float, float, float] | None = None) -> dict[str, DataFrame]:
    """The layers of a configuration: name -> id, geometry and attributes.

    A layer has geometry (point, line or polygon), input-geometries (which are taken; default: the same), an optional
    selector and attributes. Areas taken as points become a point inside them.
    """
    out = {}
    for name, spec in config["layers"].items():
        wanted = spec.get("input-geometries", [spec["geometry"]])
        rows = found.where(F.col("geometry")["type"].isin(*[t for w in wanted for t in INPUTS[w]]))
        if "selector" in spec:
            rows = rows.where(attributes.selection(spec["selector"], F.col("tags")))
        if area is not None:
            b = F.col("geometry")["box"]
            rows = rows.where((b["x0"] <= area[2]) & (b["x1"] >= area[0]) & (b["y0"] <= area[3]) & (b["y1"] >= area[1]))
        rows = attributes.extract(rows, spec.get("attributes", []))
        if spec["geometry"] == "point" and wanted != ["point"]:
            rows = rows.withColumn("geometry", _inner(F.col("geometry")))
        out[name] = rows.drop("tags")
    return out


def _inner(g: Column) -> Column:
    @F.pandas_udf(geo.POINT)
    def place(parts: pd.Series) -> pd.DataFrame:
        rows = [kernels.inner_point(kernels.rings(p)[0][0]) if p is not None else (None, None) for p in parts]
        return pd.DataFrame(rows, columns=["x", "y"])

    p = place(g["parts"])
    return F.when(g["type"] == "Point", g).otherwise(geo.point(p["x"], p["y"], 4326))


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
