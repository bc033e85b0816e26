"""Geohashes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of a geohash (a fixed value of the format).
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
SIZE = 20


def _steps(value: Column, low: float, span: float, bits: int) -> Column:
    return F.least(F.floor((value - low) / span * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def geohash(lon: Column, lat: Column, size: int = SIZE) -> Column:
    """Geohash of a place with `size` characters: bits of longitude and latitude take turns."""
    bits = (5 * size + 1) // 2
    axes = F.struct(_steps(lon, -180.0, 360.0, bits).alias("x"), _steps(lat, -90.0, 180.0, bits).alias("y"))

    def digits(a: Column) -> Column:
        def bit(i: Column) -> Column:
            at = F.floor(i / 2).cast("int")
            value = F.when(i % 2 == 0, a["x"]).otherwise(a["y"])
            return F.call_function("shiftright", value, F.lit(bits - 1) - at).bitwiseAND(F.lit(1).cast("long"))

        def digit(k: Column) -> Column:
            value = F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0).cast("long"), lambda v, i: v * 2 + bit(k * 5 + i))
            return F.substring(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), digit), "")

    # One expression of a fixed size, whatever the number of digits: long chains take the compiler longer than the rows.
    return F.transform(F.array(axes), digits)[0]


def cell_key(lon: Column, lat: Column) -> Column:
    """The reversed geohash: what tells neighbours apart comes first."""
    return F.reverse(geohash(lon, lat))
