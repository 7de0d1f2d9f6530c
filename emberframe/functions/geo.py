"""Column expressions on the globe."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LATITUDE_KM, LONGITUDE_KM, EARTH_KM = 110.574, 111.320, 6371.0
FOOTPRINT_KM = 1.0  #: of a detection without a pixel size


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def lon_between(column: Column, west: float, east: float) -> Column:
    """Within a range of longitudes that may cross the antimeridian."""
    return column.between(west, east) if west <= east else (column >= west) | (column <= east)


def in_bbox(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lat.between(south, north) & lon_between(lon, west, east)


def footprint_km(scan: Column, track: Column) -> Column:
    half = F.hypot(F.coalesce(scan, F.lit(0.0)), F.coalesce(track, F.lit(0.0))) / 2
    return F.when(half > 0, half).otherwise(F.lit(FOOTPRINT_KM))


@F.arrow_udf(DoubleType())
def _heading(a: pa.Array, b: pa.Array, d: pa.Array) -> pa.Array:
    """The angle from north, in radians. Java's atan2 and the C library's, which Arrow and SQL engines call, differ in a last bit here and there."""
    level = pc.cos(b)
    north = pc.subtract(pc.multiply(pc.cos(a), pc.sin(b)), pc.multiply(pc.multiply(pc.sin(a), level), pc.cos(d)))
    return pc.atan2(pc.multiply(pc.sin(d), level), north)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in 0..360."""
    return F.pmod(F.degrees(_heading(F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1))) + 360, F.lit(360.0))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the web map's projection."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon)."""
    r = 6378137.0
    return F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2), F.degrees(x / r)


def grid_cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """(x, y) of the cell counted from the south-west corner of the world."""
    return F.floor((lon + 180) / size).cast("long"), F.floor((lat + 90) / size).cast("long")


def unwrapped(lon: Column, reference: Column) -> Column:
    """The same longitude within half a turn of the reference, so that a fire across 180 degrees is in one piece."""
    return reference + F.pmod(lon - reference + 180, F.lit(360.0)) - 180


def split_box(west: Column, east: Column) -> Column:
    """One or two (west, east): a box across 180 degrees is two."""
    part = lambda a, b: F.struct(a.alias("west"), b.alias("east"))
    return F.when(west <= east, F.array(part(west, east))).otherwise(F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east)))


def clamped(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))


def snapped(low: Column, high: Column, step: float) -> tuple[Column, Column]:
    """A range widened to multiples of step."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def ring_area_km2(ring: Column) -> Column:
    """Spherical area of a closed ring of (x, y) degrees, by the sum over its edges."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    part = lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + part(e))) * (6371.0088**2 / 2)
