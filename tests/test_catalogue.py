"""Every query of the catalogue against its SQL, and the driver entry."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from emberframe import catalogue
from emberframe.operators import events, positions
from emberframe.plans import backtests, fields, incidents, intake, workspace

PLANS = (catalogue, incidents, workspace, fields, intake, backtests)
QUERIES, SQL = {k: q for p in PLANS for k, q in p.queries().items()}, {k: q for p in PLANS for k, q in p.oracle_sql().items()}


def plain(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, small, name):
    db = duckdb.connect()
    for table in ("events", "orders", "supplier", "nation", "customer"):
        db.execute(f"CREATE VIEW {table} AS FROM '{small}/{table}.parquet'")
    found = QUERIES[name](spark, small)
    names = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert plain(found.select(*names).collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["acq_date", "n", "frp_total"]
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_components_of_chains_and_single_rows(spark):
    ids = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10), (10, 9)], "a long, b long")
    found = {r.id: r.event for r in events.components(ids, edges).collect()}
    assert found == {i: 0 for i in range(8)} | {8: 8, 9: 9, 10: 9, 11: 11}


def test_day_islands_and_gaps(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(i)) for i in (0, 1, 2, 3, 4, 5, 6, 9, 9)]
    found = events.day_islands(spark.createDataFrame(rows, "source string, acq_date date"), 5).collect()
    assert sorted((r.first_day.day, r.last_day.day, r.days) for r in found) == [(1, 5, 5), (6, 7, 2), (10, 10, 1)]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "id long, unit long, acq_ts long, latitude double, longitude double, scan double, track double")
    assert positions.segments(none).collect() == positions.latest(none).collect() == positions.interpolate(none, 5, 10).collect() == []
    assert events.space_time_pairs(none, 2.0, 6.0).collect() == []


def test_interpolation_between_two_reports(spark):
    rows = [(1, 7, 0, 10.0, 20.0), (2, 7, 100, 20.0, 40.0), (3, 8, 50, 1.0, 2.0), (4, 9, 0, 0.0, 0.0), (5, 9, 9999, 1.0, 1.0)]
    found = positions.interpolate(spark.createDataFrame(rows, "id long, unit long, acq_ts long, latitude double, longitude double"), 50, 600).collect()
    assert sorted((r.unit, r.gap, r.latitude, r.longitude) for r in found) == [(7, 100, 15.0, 30.0), (8, 0, 1.0, 2.0)]


def test_pairs_gather_no_side_in_the_driver(spark, small):
    assert "Broadcast" not in catalogue.space_time_pairs(spark, small)._jdf.queryExecution().executedPlan().toString()
