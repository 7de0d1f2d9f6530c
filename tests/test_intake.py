"""Edges of feeds and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.sources import feeds, store

RMC = "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A"
GGA = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"


def bursts(spark, *bodies):
    rows = [(i, "T1", 1_705_000_000, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload_id long, callsign string, received long, body string")


def test_sentences_of_an_instant_are_merged(spark):
    taken, refused = feeds.fixes_of(bursts(spark, f"{GGA}\r\nnoise\r\n{RMC}", GGA, RMC.replace("6A", "6B"), "", None, GGA.partition("*")[0].replace("4807.038", "4860.000"), "$GPRMC,123519,V,4807.038,N,01131.000,E,0,0,230394,,"))
    found = {r.payload_id: r for r in taken.collect()}
    assert set(found) == {0, 1}
    both = found[0]
    assert (both.observed, both.sentences) == (764_426_119.0, "GGA,RMC")  # 1994-03-23 12:35:19
    assert abs(both.latitude - 48.1173) < 1e-9 and abs(both.longitude - (11 + 31 / 60)) < 1e-9
    assert (both.speed_kmh, both.heading, both.altitude_m, both.accuracy_m) == (41.485, 84.4, 545.4, 4.5)
    assert found[1].observed == 1_705_000_000 // 86_400 * 86_400 + 12 * 3600 + 35 * 60 + 19 and found[1].speed_kmh is None
    assert {r.payload_id: r.reason for r in refused.collect()} == {2: "checksum", 3: "no_positions", 4: "no_positions", 5: "unreadable", 6: "no_fix"}


def test_csv_rows_are_taken_or_refused_one_by_one(spark):
    head = "latitude,longitude,brightness,acq_date,acq_time,satellite,confidence\n"
    good = head + '10.123456,20,300,2024-01-02,5,"A,""b""",h\n,20,300,2024-01-02,5,A,n\n1,2,3,2024-02-30,0005,A,n\n1,2,,2024-02-03,,A,\n1e1,-2,x,2024-02-03,2359,,85\n' + ",".join("1" for _ in range(60))
    payloads = spark.createDataFrame([(1, "S", good), (2, "S", "Invalid MAP_KEY"), (3, "S", None), (4, "S", head)], "payload_id long, source string, body string")
    taken, refused = feeds.detections_of(payloads)
    found = sorted((r.line, r.latitude, r.acq_time, r.acq_ts, r.satellite, r.confidence_pct, r.confidence_level, r.brightness) for r in taken.collect())
    assert found == [(1, 10.12346, "0005", 1_704_153_900, 'A,"b"', None, "high", 300.0), (5, 10.0, "2359", 1_707_004_740, None, 85, "high", None)]
    assert {r.line: r.reason for r in refused.collect()} == {2: "position", 3: "timestamp", 4: "acq_time", 6: "too_many_fields"}
    assert {r.payload_id: r.f for r in payloads.select("payload_id", feeds.failure_of(F.col("body")).alias("f")).collect()} == {1: None, 2: "key", 3: "unrecognised", 4: None}


def test_merge_replaces_rows_by_key_and_touches_only_their_days(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    row = lambda day, key, value, seq: (day, key, value, seq)
    load = lambda *rows: store.merge(spark.createDataFrame(rows, "day string, k long, v double, seq long"), path, ("day", "k"), "day", "seq")
    load(row("d1", 1, 1.0, 1), row("d1", 2, 2.0, 2), row("d2", 1, 3.0, 3), row("d1", 1, 9.0, 0))
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "day=d2").iterdir()}
    table = load(row("d1", 1, None, 1), row("d3", None, 5.0, 1))
    table = load(row("d1", 1, None, 1), row("d3", None, 5.0, 1))  # the same load again
    assert sorted(map(str, map(tuple, table.collect()))) == sorted(map(str, [("d1", 1, None, 1), ("d1", 2, 2.0, 2), ("d2", 1, 3.0, 3), ("d3", None, 5.0, 1)]))
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "day=d2").iterdir()} == before


def test_cells_across_180_degrees_and_of_wide_boxes(spark):
    boxes = spark.createDataFrame([(1, 175.0, -5.0, -175.0, 5.0), (2, -100.0, -80.0, 100.0, 80.0), (3, 0.0, 5.0, 10.0, -5.0)], "box_id long, west double, south double, east double, north double")
    found = {}
    for r in store.cells_of_boxes(boxes, 10.0, 64).collect():
        found.setdefault(r.box_id, set()).add((r.cell_x, r.cell_y))
    assert found == {1: {(35, 8), (35, 9), (0, 8), (0, 9)}, 2: {(-1, -1)}, 3: {(18, 8), (18, 9)}}


def test_each_csv_line_is_parsed_once(spark):
    """One parse for first lines and one for the others, and no payload joined with its own lines."""
    body = "latitude,longitude,acq_date,acq_time,confidence\n\n1.5,2.5,2024-01-01,130,h\n" + ",".join("x" * 50) + "\n"
    payloads = spark.createDataFrame([(1, "S", body)], "payload_id long, source string, body string")
    taken, refused = feeds.detections_of(payloads)
    plan = taken.drop("raw_json")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") <= 2 and "Join" not in plan
    assert [(r.line, r.latitude, r.acq_time, r.confidence_level) for r in taken.collect()] == [(2, 1.5, "0130", "high")]
    assert [(r.line, r.reason) for r in refused.collect()] == [(3, "too_many_fields")]
