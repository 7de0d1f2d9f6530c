"""What the findings of round 4 named, each on input that went wrong before."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from emberframe.operators import swaths
from emberframe.plans import workspace

TRACK, AREA = "satellite string, ts long, lat double, lon double, half_width_km double", "area_id long, west double, south double, east double, north double, unit string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, query, sql, folder, tables):
    """Rows of one side only: of the query and of its SQL over the same tables."""
    db = duckdb.connect()
    for name, select in tables.items():
        db.execute(f"COPY ({select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    found = query(spark, str(folder))
    names = ", ".join(found.columns)
    rows, want = {tuple(r) for r in found.collect()}, set(db.execute(f"SELECT {names} FROM ({sql})").fetchall())
    return rows - want, want - rows


def test_bearings_at_the_edge_of_a_unit(spark, tmp_path):
    """the only two of 882 million positions (users 0 to 89,999) where a last bit moves a bearing to another unit."""
    events = "SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-02 03:04:05' AS ts, CAST(u AS BIGINT) AS user_id, 'click' AS event_type, 1e0 AS value, '{\"k\": 7}' AS props FROM (VALUES (8864, 53689), (3283, 62025), (1, 2)) AS t(i, u)"
    assert against_sql(spark, workspace.geo_scalars, workspace.SQL["geo_scalars"], tmp_path, {"events": events}) == (set(), set())


def test_passes_meet_lists_of_areas(spark):
    """a row per area and pass comes of a list, not of a join; samples that no place's row of cells is near are not spread over columns; few bytes stay many tasks."""
    rng = random.Random(3)
    rows = [("N" if i % 3 else "T", 60 * (i // 2) - 86_400, rng.uniform(-90, 90), rng.uniform(-180, 180), (None, -1.0, 0.0, 1500.0, 9000.0)[rng.randrange(5)]) for i in range(600)]
    rows += [("N", 60, None, 1.0, 1500.0), ("N", 60, 1.0, None, 1500.0), ("N", None, 1.0, 1.0, 1500.0)]
    tracks = spark.createDataFrame(rows, TRACK)
    where = [(rng.uniform(-88, 88), rng.uniform(-179, 179)) for _ in range(12)]
    boxes = [(i, lon - 1, lat - 1, lon + 1, lat + 1, None) for i, (lat, lon) in enumerate(where * 40)]
    areas = spark.createDataFrame(boxes, AREA)
    places = swaths.spots(areas).distinct()
    plain = tracks.crossJoin(F.broadcast(places)).where(swaths.haversine_km(F.col("lat"), F.col("lon"), F.col("area_lat"), F.col("area_lon")) <= F.col("half_width_km"))
    met = swaths.in_swath(tracks, places)
    assert sorted(map(str, met.collect())) == sorted(map(str, plain.select(*met.columns).collect())) and met.count() > 500
    assert "LeftSemi" in plan_of(met)
    found = swaths.passes(tracks, areas)
    assert "explode(ids" in plan_of(found) and "REPARTITION_BY_NUM" in plan_of(found)
    by_area = {}
    for r in found.collect():
        by_area.setdefault(r.area_id, []).append((r.satellite, r.ts))
    assert len(by_area) == 480 and all(sorted(by_area[i], key=str) == sorted(by_area[i % 12], key=str) for i in by_area)


def test_clear_passes_ask_for_a_bin_once(spark):
    """detections of units without areas go first, and of a unit's bin only the first and the last are met; the edges of the window count."""
    rng = random.Random(4)
    tracks = spark.createDataFrame([("N", t, 10.0, 20.0, 600.0) for t in range(-90_000, 90_000, 1200)], TRACK)
    areas = spark.createDataFrame([(i, 19.9, 9.9, 20.1, 10.1, None if i % 4 == 3 else f"u{i % 4}") for i in range(12)], AREA)
    hits = [(f"u{rng.randrange(9)}", 1200 * rng.randrange(-75, 75) + rng.choice((-1801, -1800, 1799, 1800, 1801))) for _ in range(60)]
    hits += [("u1", 7200 + i) for i in range(300)] + [(None, 0), ("u0", None)]
    seen = swaths.clear_passes(tracks, areas, spark.createDataFrame(hits, "unit string, acq_ts long"), by="unit")
    every = swaths.passes(tracks, areas).collect()
    unit = lambda i: None if i % 4 == 3 else f"u{i % 4}"
    want = [(r.area_id, r.ts) for r in every if not any(u is not None and u == unit(r.area_id) and t is not None and abs(t - r.ts) <= 1800 for u, t in hits)]
    assert sorted((r.area_id, r.ts) for r in seen.collect()) == sorted(want) and 0 < len(want) < len(every)
    plan = plan_of(seen)
    assert "min(acq_ts" in plan and "max(acq_ts" in plan and plan.count("LeftSemi") > plan_of(swaths.passes(tracks, areas)).count("LeftSemi")
