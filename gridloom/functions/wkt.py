"""Geometries from well-known text and binary and from GeoJSON, and back to text."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as geo

#: Geometry types that a layer can have.
ALLOWED = ("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
_SHAPE = f"struct<type:string,parts:{geo.PARTS}>"
#: Type numbers of well-known binary (fixed values of the format).
_NUMBERS = {1: "Point", 2: "LineString", 3: "Polygon", 5: "MultiLineString", 6: "MultiPolygon"}


class GeometryFormatError(ValueError):
    """Text or bytes that are no geometry of an allowed type."""


def _dots(points) -> list[dict]:
    return [{"x": float(p[0]), "y": float(p[1])} for p in points]


def from_coordinates(kind: str, c) -> dict:
    """Parts from the nested coordinates of GeoJSON; heights are left out."""
    shapes = {"Point": lambda: [[_dots([c])]], "LineString": lambda: [[_dots(c)]], "MultiLineString": lambda: [[_dots(x)] for x in c], "Polygon": lambda: [[_dots(r) for r in c]], "MultiPolygon": lambda: [[_dots(r) for r in p] for p in c]}
    if kind not in shapes:
        raise GeometryFormatError(f"geometry type {kind} is not supported")
    return {"type": kind, "parts": shapes[kind]()}


def parse_wkt(text: str) -> dict:
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*", text, re.S)
    kind = {k.upper(): k for k in ALLOWED}.get(m[1].upper()) if m else None
    if not kind:
        raise GeometryFormatError(f"not a supported geometry: {text[:60]!r}")
    body = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)+)", lambda p: "[" + ",".join(p[1].split()) + "]", m[2])
    import json

    nested = json.loads(body.replace("(", "[").replace(")", "]"))
    return from_coordinates(kind, nested[0] if kind == "Point" else nested)


def parse_wkb(data: bytes) -> dict:
    at = 0

    def read(fmt: str):
        nonlocal at
        values = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return values

    def shape() -> tuple[str, list]:
        order = "<" if read("B")[0] else ">"
        (code,) = read(order + "I")
        if code & 0x20000000:
            read(order + "I")
        height = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
        kind = _NUMBERS.get((code & 0xFFFF) % 1000)
        dot = order + ("ddd" if height else "dd")
        count = lambda: read(order + "I")[0]
        if kind == "Point":
            return kind, list(read(dot)[:2])
        if kind == "LineString":
            return kind, [read(dot)[:2] for _ in range(count())]
        if kind == "Polygon":
            return kind, [[read(dot)[:2] for _ in range(count())] for _ in range(count())]
        if kind:
            return kind, [shape()[1] for _ in range(count())]
        raise GeometryFormatError(f"geometry type {code} is not supported")

    return from_coordinates(*shape())


def _texts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{"type": None, "parts": None} if t is None else parse_wkt(t) for t in text], columns=["type", "parts"])


def _binaries(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{"type": None, "parts": None} if d is None else parse_wkb(bytes(d)) for d in data], columns=["type", "parts"])


def of_shape(shape: Column, srid: int = 0) -> Column:
    """A geometry from struct<type, parts>; null without parts."""
    first = shape["parts"][0][0][0]
    dot = geo.point(first["x"], first["y"], srid)
    return F.when(shape["parts"].isNull(), None).when(shape["type"] == "Point", dot).otherwise(geo.from_parts(shape["type"], shape["parts"], srid))


def from_wkt(text: Column, srid: int = 0) -> Column:
    return of_shape(F.pandas_udf(_texts, _SHAPE)(text), srid)


def from_wkb(data: Column, srid: int = 0) -> Column:
    return of_shape(F.pandas_udf(_binaries, _SHAPE)(data), srid)


def to_wkt(g: Column) -> Column:
    """Well-known text; a box is written as a polygon."""
    dots = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, dots), ", "), F.lit(")"))
    parts = geo.parts_of(g)
    b = g["box"]
    return (
        F.when(g["type"] == "Point", F.concat(F.lit("POINT ("), b["x0"], F.lit(" "), b["y0"], F.lit(")")))
        .when(g["type"].isin("Box", "Polygon"), F.concat(F.lit("POLYGON "), rings(parts[0])))
        .when(g["type"] == "LineString", F.concat(F.lit("LINESTRING "), dots(parts[0][0])))
        .when(g["type"] == "MultiLineString", F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(parts, lambda p: dots(p[0])), ", "), F.lit(")")))
        .otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(parts, rings), ", "), F.lit(")")))
    )
