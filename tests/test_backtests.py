"""Backtests: nothing later changes what a split trains on; pooled scores; missed fronts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberframe.operators import validation

SEEN = "id long, unit long, acq_ts long, latitude double, longitude double"


def test_later_rows_don_t_change_a_prediction(spark):
    rows = [(i, 1, i * 100, 75.0 + i * 0.002, 179.99 + i * 0.004 - (360 if i > 2 else 0)) for i in range(16)]  # across 180 degrees, far north
    df = spark.createDataFrame(rows, SEEN)
    found = validation.backtest(df, "unit", 10**6, {"a": 0.3, "b": 50.0}, splits=1).collect()
    train = {r.train for r in found}
    assert len(train) == 1
    n = train.pop()
    assert {r.id for r in found} == {i for i in range(16) if i >= n}
    assert all(r.probability == 1.0 for r in found if r.model == "b") and {r.probability for r in found if r.model == "a"} == {0.0, 1.0}
    moved = spark.createDataFrame([r if r[0] < n else (*r[:3], r[3] + (1.0 if r[0] > n else 0.0), r[4]) for r in rows], SEEN)
    again = {(r.id, r.model): r.probability for r in validation.backtest(moved, "unit", 10**6, {"a": 0.3, "b": 50.0}, splits=1).where(F.col("id") == n).collect()}
    assert again == {(r.id, r.model): r.probability for r in found if r.id == n}


def test_scores_are_pooled_not_averaged(spark):
    splits = spark.createDataFrame([("m", 1, 0, 9, 0, 0.5), ("m", 90, 10, 0, 0, 0.1), ("m", 0, 0, 0, 4, None), ("z", 0, 0, 0, 0, None)], "model string, tp long, fp long, fn long, tn long, brier double")
    found = {r.model: r for r in validation.pooled_scores(splits, "model").collect()}
    m = found["m"]
    assert (m.splits, m.precision, m.recall, m.jaccard) == (3, 91 / 101, 91 / 100, 91 / 110)
    assert m.f1 == pytest.approx(182 / 201) and m.brier == pytest.approx((0.5 * 10 + 0.1 * 100) / 110)
    assert (found["z"].precision, found["z"].recall, found["z"].brier) == (None, None, None)


def test_a_front_that_no_member_reaches_is_missed(spark):
    rows = [("m", 1, 0.9), ("m", 1, 0.0), ("m", 2, 0.4), ("m", 2, None), ("k", 1, 0.5)]
    found = {r.model: (r.fronts, r.missed) for r in validation.missed_fronts(spark.createDataFrame(rows, "model string, front long, probability double"), "model").collect()}
    assert found == {"m": (2, 1), "k": (1, 0)}
