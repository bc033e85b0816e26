"""Layers from GeoJSON and from tables with text or binary geometries; and layers as stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import project, wkt
from ..functions.translate import Translation
from ..operators.grid import clip


class LayerError(ValueError):
    """A file that can't be imported as a layer."""


def geojson_text(lines: DataFrame, srid: int = 4326) -> DataFrame:
    """Features of GeoJSON documents (one document or feature in each row of `value`): id, properties (a map), geometry."""
    shape = "type string, coordinates string"
    feature = f"struct<id:string,properties:map<string,string>,geometry:struct<{shape.replace(' ', ':').replace(',:', ',')}>>"
    spec = f"type string, id string, properties map<string,string>, geometry struct<{shape.replace(' ', ':').replace(',:', ',')}>, features array<{feature}>"
    doc = lines.select(F.from_json("value", spec).alias("d"))
    one = F.struct(F.col("d.id").alias("id"), F.col("d.properties").alias("properties"), F.col("d.geometry").alias("geometry"))
    rows = doc.select(F.explode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array(one))).alias("f"))
    return rows.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), _from_json(F.col("f.geometry"), srid).alias("geometry"))


def _from_json(g, srid: int):
    """Coordinates come as JSON text; each type has its own nesting."""
    dot = "array<double>"
    nest = {"Point": dot, "LineString": f"array<{dot}>", "MultiLineString": f"array<array<{dot}>>", "Polygon": f"array<array<{dot}>>", "MultiPolygon": f"array<array<array<{dot}>>>"}
    c = {k: F.from_json(F.when(g["type"] == k, g["coordinates"]), v) for k, v in nest.items()}
    at = lambda p: geo.xy(p[0], p[1])
    path = lambda r: F.transform(r, at)
    made = F.when(g["type"] == "Point", geo.point(c["Point"][0], c["Point"][1], srid))
    made = made.when(g["type"] == "LineString", geo.from_parts("LineString", F.array(F.array(path(c["LineString"]))), srid))
    made = made.when(g["type"] == "MultiLineString", geo.from_parts("MultiLineString", F.transform(c["MultiLineString"], lambda r: F.array(path(r))), srid))
    made = made.when(g["type"] == "Polygon", geo.from_parts("Polygon", F.array(F.transform(c["Polygon"], path)), srid))
    return made.when(g["type"] == "MultiPolygon", geo.from_parts("MultiPolygon", F.transform(c["MultiPolygon"], lambda p: F.transform(p, path)), srid))


def read_geojson(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """GeoJSON files, whole documents (many files are read in parallel) or a feature per line (.jsonl, .geojsonl)."""
    whole = not path.rstrip("/").endswith(("jsonl", "ndjson"))
    return geojson_text(spark.read.text(path, wholetext=whole), srid)


def property_columns(layer: DataFrame) -> DataFrame:
    """The map `properties` as columns: whole numbers, other numbers, or text where any value is not a number.

    Names are collected, so they must be as few as a table's columns. One that is taken, in either case, gets a number.
    """
    value = F.col("value")
    whole, number = (F.min(F.coalesce(c, F.lit(True))) for c in (value.rlike(r"^-?(0|[1-9]\d{0,17})$"), value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$")))
    names = layer.select(F.explode("properties")).groupBy("key").agg(whole.alias("whole"), number.alias("number")).orderBy("key").collect()
    rest = [c for c in layer.columns if c != "properties"]
    taken, made = {c.lower() for c in rest}, []
    for row in names:
        name, n = row["key"], 0
        while name.lower() in taken:
            n += 1
            name = f"{row['key']}_{n}"
        taken.add(name.lower())
        kind = "bigint" if row["whole"] else "double" if row["number"] else "string"
        made.append(F.try_element_at("properties", F.lit(row["key"])).cast(kind).alias(name))
    return layer.select(*rest, *made)


def import_layer(layer: DataFrame, source_srid: int, target_srid: int, area: tuple[float, float, float, float] | None = None, kind: str | None = None) -> DataFrame:
    """A layer in the study's reference system, cut to rows whose box meets the area.

    kind: a geometry type that rows must have; a single polygon or line becomes a multiple one where that is asked for.
    """
    out = layer.where(F.col("geometry").isNotNull())
    if source_srid != target_srid:
        out = out.withColumn("geometry", project.transform_geometry(F.col("geometry"), source_srid, target_srid))
    if area is not None:
        out = clip(out, area)
    if kind:
        if kind not in wkt.ALLOWED:
            raise LayerError(f"geometry type {kind} is not supported")
        g = F.col("geometry")
        if kind.startswith("Multi"):
            single = g["type"] == kind.removeprefix("Multi")
            out = out.withColumn("geometry", F.when(single, g.withField("type", F.lit(kind))).otherwise(g))
        out = out.where(F.col("geometry")["type"] == kind)
    return out


def import_many(spark: SparkSession, pattern: str, source: str, target: str, translation: Translation, srid: int = 4326) -> DataFrame:
    """All GeoJSON files of a glob as one layer with one translated property."""
    rows = read_geojson(spark, pattern, srid)
    value = F.try_element_at("properties", F.lit(source))
    return rows.select(translation.column(value).alias(target), "geometry")
