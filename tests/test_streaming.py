"""Late, repeated, conflicting and refused reports over several runs of the stream; state outlives them."""

from __future__ import annotations

import math

from emberframe.streaming import telemetry

BASE = 1_705_000_000


def report(i, ext, at, received=None, lat=40.0, lon=10.0, acc=5.0, unit=1, call="E1"):
    return (i, ext, call, unit, BASE + at, BASE + (at if received is None else received), lat, lon, 10.0, acc, 0.0)


def run(spark, tmp_path, rows):
    """Appends rows and runs the stream anew from its checkpoint."""
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(rows, telemetry.REPORT).coalesce(1).write.mode("append").parquet(source)
    telemetry.start(spark.readStream.schema(telemetry.REPORT).parquet(source), folder).awaitTermination()
    return folder


def test_stream_of_reports(spark, tmp_path):
    first = [report(1, "a", 0), report(2, "b", 60, acc=500.0), report(3, "b", 61), report(4, None, 70), report(5, "x", 10_000, received=0), report(6, "u", 0, unit=2, lat=95.0), report(11, "c1", 5, call=" ")]
    folder = run(spark, tmp_path, first)
    run(spark, tmp_path, [report(7, "a", 0), report(8, "c", 30, received=2000), report(9, "d", 120, lat=41.0), report(10, "e", 3000, unit=2), report(12, "a", 1), report(13, "a", 0, unit=2)])
    no = False
    found = {r.id: (r.late, r.out_of_order, r.poor_accuracy, r.implausible_speed) for r in telemetry.taken(spark, folder).collect()}
    assert found == {1: (no, no, no, no), 2: (no, no, True, no), 8: (True, True, no, no), 9: (no, no, no, True), 10: (no, no, no, no), 13: (no, True, no, no)}
    refused = {r.id: r.reason for r in telemetry.refused(spark, folder).collect()}
    required = "missing_external_id_or_callsign"
    assert refused == {3: "duplicate_in_batch", 4: required, 5: "future", 6: "latitude", 11: required, 12: "conflict"}
    assert {r.id for r in spark.read.parquet(f"{folder}/reports").where("reason = 'replayed'").collect()} == {7}
    assert {(r.unit, r.callsign): r.id for r in telemetry.latest(spark, folder).collect()} == {(1, "E1"): 9, (2, "E1"): 10}
    # the derived speed is that between positions, also across runs
    (nine,) = telemetry.taken(spark, folder).where("id = 9").collect()
    assert abs(nine.derived_speed_kmh - 2 * 6371.0088 * math.asin(math.sin(math.radians(0.5))) / (60 / 3600)) < 0.01
    run(spark, tmp_path, [report(14, "f", 90), report(15, "g", 150, lat=41.0, call="E2")])  # older than what two runs before have left
    again = {r.id: (r.out_of_order, r.newest) for r in telemetry.taken(spark, folder).where("id > 13").collect()}
    assert again == {14: (True, False), 15: (False, True)}
    ring = [(9.9, 40.9), (10.1, 40.9), (10.1, 41.1), (9.9, 41.1), (9.9, 40.9)]
    areas = spark.createDataFrame([("h", ring)], "incident_id string, ring array<struct<x:double,y:double>>")
    warned = telemetry.hazard_warnings(spark.read.parquet(f"{folder}/reports"), areas)
    assert sorted((r.id, r.callsign) for r in warned.collect()) == [(9, "E1"), (15, "E2")]


def test_a_refused_report_doesn_t_use_up_its_id(spark, tmp_path):
    folder = run(spark, tmp_path, [report(1, "a", 0, lat=95.0), report(2, "a", 0), report(3, "a", 0)])
    assert {r.id: r.reason for r in telemetry.refused(spark, folder).collect()} == {1: "latitude", 3: "duplicate_in_batch"}
    assert {r.id for r in telemetry.taken(spark, folder).collect()} == {2}
