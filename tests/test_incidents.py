"""Edges of the incident operators."""

from __future__ import annotations

from emberframe.operators import incidents, industrial, validation

SEEN = "id long, unit long, acq_ts long, latitude double, longitude double, source string"


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SEEN)
    known = spark.createDataFrame([], "source_id long, lat double, lon double, radius_km double")
    assert industrial.match_nearest(none, known).collect() == validation.holdout_splits(none, "unit").collect() == validation.growth(none, "unit").collect() == []
    assert [r.n for r in incidents.exposure(spark.createDataFrame([], "hours double")).collect()] == [0] * 8


def test_equally_near_sources_and_the_edge_of_a_cell(spark):
    seen = spark.createDataFrame([(1, 1, 0, 40.0, 10.0, "a"), (2, 1, 0, 45.0, 10.0, "a")], SEEN)
    known = spark.createDataFrame([(7, 39.999, 10.0, 2.0), (3, 39.999, 10.0, 2.0)], "source_id long, lat double, lon double, radius_km double")
    assert [(r.id, r.source_id) for r in industrial.match_nearest(seen, known).collect()] == [(1, 3)]


def test_a_wide_radius_in_the_north_and_across_the_antimeridian(spark):
    seen = spark.createDataFrame([(1, 1, 0, 75.0, 10.6, "a"), (2, 1, 0, 40.0, -179.95, "a"), (3, 1, 0, 40.25, 10.0, "a")], SEEN)
    known = spark.createDataFrame([(7, 75.0, 10.0, 20.0), (8, 40.0, 179.98, 8.0), (9, 40.0, 10.0, 30.0)], "source_id long, lat double, lon double, radius_km double")
    assert sorted((r.id, r.source_id) for r in industrial.match_nearest(seen, known).collect()) == [(1, 7), (2, 8), (3, 9)]


def test_tiles_beyond_the_map(spark):
    from emberframe.operators import validation

    rows = spark.createDataFrame([(40.0, 179.9), (40.0, 180.1), (40.0, 684.0), (40.0, -200.0)], "latitude double, longitude double")
    x = lambda clamped: [r.x for r in rows.select(validation.tile_of(12, clamped)[0].alias("x")).collect()]
    assert x(True) == [4094, 4095, 4095, 0] and x(False) == [4094, 4097, 9830, -228]
