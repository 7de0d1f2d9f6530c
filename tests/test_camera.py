"""UTM and camera geometry against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberframe.functions import camera


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_utm_of_known_points(spark):
    east, north = camera.to_utm(F.lit(0.0), F.lit(3.0), F.lit(31))
    back = camera.from_utm(F.lit(500_000.0), F.lit(10_000_000.0 - 1000.0), F.lit(31), F.lit(False))
    r = one(spark, east.alias("e"), north.alias("n"), back[0].alias("lat"), back[1].alias("lon"), camera.zone_of(F.lit(179.9)).alias("last"), camera.zone_of(F.lit(-180.0)).alias("first"), camera.from_utm(F.lit(5e5), F.lit(0.0), F.lit(61), F.lit(True))[0].alias("none"))
    assert (round(r.e, 6), round(r.n, 6), r.last, r.first, r.none) == (500_000.0, 0.0, 60, 1, None)
    assert r.lon == pytest.approx(3.0) and -0.00905 < r.lat < -0.00904


def test_a_frame_straight_down_and_one_that_holds_the_sky(spark):
    corners, reason = camera.ground_corners(F.lit(100.0), F.lit(1000.0), F.lit(2000.0), F.lit(1000.0), F.lit(-90.0), F.lit(0.0))
    sky = camera.ground_corners(F.lit(100.0), F.lit(1000.0), F.lit(2000.0), F.lit(1000.0), F.lit(-20.0), F.lit(0.0))[1]
    low = camera.ground_corners(F.lit(0.0), F.lit(1000.0), F.lit(2000.0), F.lit(1000.0), F.lit(-90.0), F.lit(0.0))[1]
    east = camera.ground_corners(F.lit(100.0), F.lit(1000.0), F.lit(2000.0), F.lit(1000.0), F.lit(-45.0), F.lit(90.0))[0]
    r = one(spark, corners.alias("c"), reason.alias("r"), sky.alias("sky"), low.alias("low"), east.alias("east"))
    assert [(round(p.x, 6), round(p.y, 6)) for p in r.c] == [(-100.0, 50.0), (100.0, 50.0), (100.0, -50.0), (-100.0, -50.0)]
    assert (r.r, r.sky, r.low) == (None, "horizon", "height")
    assert all(p.x > 0 for p in r.east)  # it looks east


def test_focal_length_by_the_first_route_that_its_fields_allow(spark):
    n = F.lit(None).cast("double")
    w = F.lit(4000.0)
    cases = [(F.lit(3666.5), F.lit(8.8), n, n, n, n), (n, F.lit(8.8), F.lit(4000 / 13.2 * 25.4), F.lit(2), n, n), (n, F.lit(8.8), n, n, F.lit(13.2), n), (n, n, n, n, n, F.lit(24.0)), (n, n, n, n, n, n)]
    r = one(spark, *[camera.focal_pixels(w, *c).alias(f"c{i}") for i, c in enumerate(cases)])
    assert [x.route for x in r] == ["calibrated", "focal_plane", "sensor_width", "equivalent", "none"]
    assert [x.pixels for x in r] == pytest.approx([3666.5, 8.8 * 4000 / 13.2, 8.8 * 4000 / 13.2, 24 * 4000 / 36, None])


def test_offsets(spark):
    lat, lon = camera.moved(F.lit(60.0), F.lit(10.0), F.lit(1000.0), F.lit(1000.0))
    r = one(spark, lat.alias("lat"), lon.alias("lon"))
    assert r.lat == pytest.approx(60.008974, abs=1e-5) and r.lon == pytest.approx(10.017921, abs=1e-5)


def test_utm_of_longitudes_some_turns_away(spark):
    rows = [(i, lat, lon) for i, (lat, lon) in enumerate((a, b + 360.0 * k) for a in (-36.5, 42.25) for b in (-179.5, 10.3, 121.6) for k in (-1, 0, 1, 18))]
    placed = spark.createDataFrame(rows, "i int, lat double, lon double").withColumn("zone", camera.zone_of(F.col("lon")))
    east, north = camera.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    found = [(r.zone, round(r.e, 3), round(r.n, 3)) for r in placed.select("i", "zone", east.alias("e"), north.alias("n")).orderBy("i").collect()]
    for at in range(0, len(found), 4):
        assert len(set(found[at : at + 4])) == 1 and 160_000 < found[at][1] < 840_000
