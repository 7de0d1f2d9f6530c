"""Values that the library must give, one by one: text, telemetry rules, moisture, heat, wind."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from emberframe.functions import text
from emberframe.operators import positions, surfaces, workspace


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_wind_speeds_and_directions(spark):
    found = values(spark, text.speed, ["10", "10 m/s", "36 km/h", "36KMH", "10 kt", "10 Knots", "2,5 ms-1", "10 mph", "fast", "-3", "1e3", None])
    assert found == pytest.approx([10, 10, 10, 10, 5.14444, 5.14444, 2.5, None, None, None, None, None])
    assert values(spark, text.direction, ["NW", "nne", "370", "-10", "45°", "45 deg", "90DEG", "", "north", "nan", None]) == pytest.approx([315, 22.5, 10, 350, 45, 45, 90, None, None, None, None])


def test_ages_slugs_and_urls(spark):
    ages = spark.createDataFrame([(s,) for s in (59.0, 3599.0, 3600.0, 9000.0, 86_399.0, 86_400.0, 200_000.0)], "s double").select(text.age_text(F.col("s"))).collect()
    assert [r[0] for r in ages] == ["0 min ago", "59 min ago", "1.0 h ago", "2.5 h ago", "24.0 h ago", "1.0 days ago", "2.3 days ago"]
    slugs = values(spark, text.slug, ["  My Layer!! 2 ", "a_b-c", "-x-", "x" * 60, "???", None])
    assert slugs[:4] == ["my-layer-2", "a_b-c", "x", "x" * 48] and all(len(s) == 8 for s in slugs[4:])
    urls = values(spark, text.redacted, ["mqtts://ops:secret@Broker.example:8883/t", "mqtt://h", "mqtt://u@h/x", "nonsense", "", None])
    assert urls == ["mqtts://ops@broker.example:8883", "mqtt://h", "mqtt://u@h", "(malformed)", "", ""]


def test_the_nine_safety_checks():
    assert workspace.CHECKS == ("hazards", "lookouts", "communications", "escape_routes", "safety_zones", "medical", "alternative_access", "withdrawal_triggers", "weather_update")


def test_telemetry_rules(spark):
    report = lambda i, ext="a", call="E1", at=0, lat=40.0, lon=10.0, speed=1.0, acc=1.0, head=0.0: (i, 1, ext, call, at, 0, lat, lon, speed, acc, head)
    nan, inf = float("nan"), float("inf")
    rows = [report(1, lat=95.0), report(2), report(3), report(4, "b", head=360.0), report(5, "c", head=360.5), report(6, "d", speed=5000.0), report(7, "e", call=" "), report(8, None), report(9, "f", at=301), report(10, "g", at=300),
            report(11, "h", speed=-1.0), report(12, "i", acc=-0.1), report(13, "j", lat=nan), report(14, "k", speed=inf), report(15, "l", lat=None), report(16, "m", at=None)]
    df = spark.createDataFrame(rows, "id long, batch long, external_id string, callsign string, observed long, received long, latitude double, longitude double, speed double, accuracy double, heading double")
    required = "missing_external_id_or_callsign"
    want = {1: "latitude", 2: None, 3: "duplicate_in_batch", 4: None, 5: "heading", 6: None, 7: required, 8: required, 9: "future", 10: None, 11: "speed", 12: "accuracy", 13: "latitude", 14: "not_finite", 15: "position", 16: "observed_at"}
    assert {r.id: r.reason for r in workspace.telemetry_rejects(df).collect()} == want


def test_tracks_break_at_180_km_an_hour(spark):
    rows = [(1, 1, 0, 40.0, 10.0), (2, 1, 600, 40.25, 10.0), (3, 1, 1200, 40.55, 10.0)]  # 167 and 200 km/h
    found = positions.segments(spark.createDataFrame(rows, "id long, unit long, acq_ts long, latitude double, longitude double")).collect()
    assert sorted(r.n for r in found) == [1, 2]


def test_moisture(spark):
    rows = [("a", i, 0.08 if i % 5 else None, 2.0 if i % 7 == 0 else None) for i in range(400)] + [("b", 3, None, 9.0)]
    found = {r.s: (r.m1, r.m10, r.m100) for r in surfaces.moisture(spark.createDataFrame(rows, "s string, hour long, target double, rain double"), "s", bin_hours=48).collect()}
    want = [0.10, 0.12, 0.14]
    for s, _, target, rain in rows[:-1]:
        if target is not None:
            for k, lag in enumerate((1.0, 10.0, 100.0)):
                t, tau = (0.35, max(1.0, lag / 4)) if (rain or 0) >= 0.5 else (target, lag)
                want[k] = t + (want[k] - t) * math.exp(-1 / tau)
    assert found["a"] == pytest.approx(want, abs=1e-12)
    assert found["b"] == (0.10, 0.12, 0.14)  # a wet hour without a target changes nothing
    air = spark.createDataFrame([(50.0, 20.0), (0.0, 150.0), (100.0, 20.0), (None, 20.0), (50.0, None)], "rh double, t double").select(surfaces.equilibrium_moisture(F.col("rh"), F.col("t"))).collect()
    base = lambda h, t: max(0.0, (0.1617 - 0.001419 * t) * max(1e-9, -math.log(1 - h)) ** (0.4657 - 0.003578 * t))
    assert [r[0] for r in air] == pytest.approx([base(0.5, 20), base(0.0, 150), base(0.99, 20), None, None])


def test_heat_of_a_wide_pixel_in_the_north(spark):
    """No cell within reach is missing: north of 70 degrees, and for the pixel at a scan's edge."""
    df = spark.createDataFrame([("MODIS", "high", 75.0, 10.0, 0, 2.0, 4.8, 10.0)], "instrument string, confidence_level string, latitude double, longitude double, acq_ts long, scan double, track double, frp double")
    found = {(r.row, r.col): r.heat for r in surfaces.heat(df, 0.01, 0).collect()}
    sigma = math.hypot(2.0, 4.8) / 2
    want = {}
    for row in range(7300, 7700):
        for col in range(500, 1500):
            km = math.hypot((10.0 - (col + 0.5) * 0.01) * 111.320 * math.cos(math.radians(75)), (75.0 - (row + 0.5) * 0.01) * 110.574)
            if km <= 5 * sigma:
                want[row, col] = min(0.999, 0.7 * math.exp(-((km / sigma) ** 2) / 2) * (1 + math.log1p(10) / 6))
    assert set(found) == set(want) and min(found.values()) < 1e-5
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_wind_at_high_latitude_across_180_and_against_a_run(spark):
    points = spark.createDataFrame([(1, 75.0, 10.0), (2, 0.0, 179.9), (3, 0.0, 50.0)], "point_id long, lat double, lon double")
    seen = spark.createDataFrame([(75.0, 11.9, 100, 10.0, 270.0), (0.0, -179.8, 100, 5.0, 180.0)], "lat double, lon double, observed long, speed double, from_deg double")
    found = {r.point_id: (round(r.u, 6), round(r.v, 6), r.n) for r in surfaces.wind_field(points, seen, 200, 3600, 60.0).collect()}
    assert found == {1: (10.0, 0.0, 1), 2: (0.0, 5.0, 1)}
    run = spark.createDataFrame([(1, 4.0, 4.0), (3, 1.0, 2.0)], "point_id long, u double, v double")
    found = {r.point_id: (round(r.u, 6), round(r.v, 6), r.n) for r in surfaces.wind_field(points, seen, 200, 3600, 60.0, run).collect()}
    assert found == {1: (10.0, 0.0, 1), 2: (0.0, 5.0, 1), 3: (1.0, 2.0, 0)}
    (r,) = spark.range(1).select(*[c.alias(n) for c, n in zip(surfaces.meteorological(F.lit(10.0), F.lit(0.0)), "sd", strict=True)]).collect()
    assert (r.s, r.d) == (10.0, 270.0)
