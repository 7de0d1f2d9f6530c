"""Projections and camera geometry as column expressions: UTM both ways, the ground corners of a frame, offsets in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the ellipsoid and of the projection
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
LEAST_DEPRESSION = 3.0  #: degrees below the horizon of a ray that is followed to the ground
PER_MM = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}  #: millimetres of a focal plane's unit; fixed values
FULL_FRAME_MM = 36.0


def _arc(phi: Column) -> Column:
    """Length of the meridian from the equator."""
    return A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi))


def zone_of(lon: Column) -> Column:
    """The zone, 1..60, of a longitude, which may lie beyond 180 degrees."""
    return (F.pmod(F.floor(F.pmod(lon + 360, F.lit(360.0)) / 6 + 30), F.lit(60)) + 1).cast("int")


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres; south of the equator with the false northing. The longitude may be any number of turns away."""
    off = lon - ((zone - 1) * 6 - 177)
    phi, away = F.radians(lat), F.radians(off - 360 * F.floor((off + 180) / 360))
    sine, cosine, tangent = F.sin(phi), F.cos(phi), F.tan(phi)
    n, t, c, a = A / F.sqrt(1 - E2 * sine * sine), tangent * tangent, EP2 * cosine * cosine, cosine * away
    east = SCALE * n * (a + (1 - t + c) * F.pow(a, F.lit(3.0)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, F.lit(5.0)) / 120) + FALSE_EASTING
    north = SCALE * (_arc(phi) + n * tangent * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4.0)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, F.lit(6.0)) / 720))
    return east, F.when(lat < 0, north + FALSE_NORTHING).otherwise(north)


def from_utm(easting: Column, northing: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """(lat, lon) by the latitude of the meridian's foot and a series around it; null for a zone outside 1..60."""
    x, y = easting - FALSE_EASTING, northing - F.when(northern, 0.0).otherwise(FALSE_NORTHING)
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = y / SCALE / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    sine, cosine, tangent = F.sin(foot), F.cos(foot), F.tan(foot)
    c, t = EP2 * cosine * cosine, tangent * tangent
    w = 1 - E2 * sine * sine
    across, along = A / F.sqrt(w), A * (1 - E2) / F.pow(w, F.lit(1.5))
    d = x / (across * SCALE)
    p = lambda k: F.pow(d, F.lit(float(k)))
    lat = foot - across * tangent / along * (p(2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * p(4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * p(6) / 720)
    lon = (d - (1 + 2 * t + c) * p(3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * p(5) / 120) / cosine
    known = zone.between(1, 60)
    return F.when(known, F.degrees(lat)), F.when(known, F.degrees(lon) + (zone - 1) * 6 - 177)


def focal_pixels(width: Column, calibrated: Column, focal_mm: Column, resolution: Column, unit: Column, sensor_mm: Column, equivalent_mm: Column) -> Column:
    """(pixels, route): focal length in pixels by the first of four routes that its fields allow; null pixels with the route `none`."""
    per = F.coalesce(*[F.when(unit == k, v) for k, v in PER_MM.items()], F.lit(25.4))
    routes = [("calibrated", calibrated), ("focal_plane", F.when(resolution > 0, focal_mm * width / (width / (resolution / per)))), ("sensor_width", F.when(sensor_mm > 0, focal_mm * width / sensor_mm)), ("equivalent", F.when(equivalent_mm > 0, equivalent_mm * width / FULL_FRAME_MM))]
    pixels = F.lit(None).cast("double")
    route = F.lit("none")
    for name, value in reversed(routes):
        fine = F.coalesce((value > 0) & (width > 0), F.lit(False))
        pixels, route = F.when(fine, value).otherwise(pixels), F.when(fine, name).otherwise(route)
    return F.struct(pixels.alias("pixels"), route.alias("route"))


def ground_corners(height_m: Column, focal_px: Column, width: Column, height: Column, pitch: Column, yaw: Column) -> tuple[Column, Column]:
    """(corners, reason): where a frame's corners meet the ground, metres (x east, y north) from the camera, upper left first and clockwise; null with a reason.

    Pitch is measured from the horizon (-90: straight down), yaw clockwise from north. A ray less than LEAST_DEPRESSION below the horizon has no corner: the footprint would be without bound.
    """
    p, w = F.radians(pitch), F.radians(yaw)

    def spun(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        return x * F.cos(w) + y * F.sin(w), y * F.cos(w) - x * F.sin(w), z

    zero = F.lit(0.0)
    axis, right, down = spun(zero, F.cos(p), F.sin(p)), spun(F.lit(1.0), zero, zero), spun(zero, F.sin(p), -F.cos(p))
    corners, shallow = [], F.lit(False)
    for u, v in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        dx, dy, dz = (a * focal_px + r * (width * u) + d * (height * v) for a, r, d in zip(axis, right, down, strict=True))
        length = F.sqrt(dx * dx + dy * dy + dz * dz)
        shallow = shallow | (dz / length > -math.sin(math.radians(LEAST_DEPRESSION)))
        corners.append(F.struct((dx / -dz * height_m).alias("x"), (dy / -dz * height_m).alias("y")))
    missing = height_m.isNull() | focal_px.isNull() | width.isNull() | height.isNull() | pitch.isNull() | yaw.isNull()
    reason = F.when(missing, "missing").when(height_m <= 0, "height").when(focal_px <= 0, "focal_length").when(shallow, "horizon")
    return F.when(reason.isNull(), F.array(*corners)), reason


def moved(lat: Column, lon: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point some metres away, by the ellipsoid's radii there."""
    phi = F.radians(lat)
    w = F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return lat + F.degrees(north_m / (A * (1 - E2) / (w * w * w))), lon + F.degrees(east_m / (A / w * F.cos(phi)))
