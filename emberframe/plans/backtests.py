"""Queries of leakage-safe backtests over the driver's tables, with their DuckDB SQL: splits of each unit's detections, models that are radii around what was seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.catalogue import HOURS, LABELS_SQL, SPEED_KMH
from emberframe.operators import clustering, validation
from emberframe.plans.incidents import _units, units
from emberframe.sources.detections import DETECTIONS_SQL, detections

HORIZON, RADII = 48 * 3600, {"near": 0.8, "wide": 2.5}
KM = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(d.latitude - o.latitude) / 2), 2e0) + cos(radians(o.latitude)) * cos(radians(d.latitude)) * pow(sin(radians(d.longitude - o.longitude) / 2), 2e0))))"
SPLITS = """r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY acq_ts, id) AS train, count(*) OVER (PARTITION BY unit) AS n FROM d), s AS (SELECT unit, train, acq_ts AS split_ts FROM r, (SELECT 1) WHERE train >= 8 AND train < n AND (train - 8) % greatest(1, (n - 8) // 5) = 0 AND train - 8 < greatest(1, (n - 8) // 5) * 5),
  q AS (SELECT unit, id, acq_ts, latitude, longitude, true AS positive FROM d UNION ALL SELECT unit, -id - 1, acq_ts, latitude + 2e-2, longitude, false FROM d WHERE id % 2 = 0),
  h AS (SELECT s.unit, s.train, s.split_ts, q.id, q.positive, q.latitude, q.longitude FROM s JOIN q ON q.unit = s.unit AND q.acq_ts > split_ts AND q.acq_ts <= split_ts + 172800)"""
NEAREST = f"{SPLITS}, k AS (SELECT o.unit, o.train, o.id, o.positive, min({KM}) AS km FROM h AS o JOIN d ON d.unit = o.unit AND d.acq_ts <= o.split_ts GROUP BY ALL), z AS (SELECT k.*, model, CASE WHEN km <= radius THEN 1e0 ELSE 0e0 END AS p FROM k, (VALUES ('near', 8e-1), ('wide', 25e-1)) AS v(model, radius))"


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as positives, every second one moved two hundredths of a degree north as a place where nothing was seen."""
    seen = detections(spark, sf_dir)
    nothing = seen.where("id % 2 = 0").select("unit", (-F.col("id") - 1).alias("id"), "acq_ts", (F.col("latitude") + 0.02).alias("latitude"), "longitude")
    return validation.backtest(seen, "unit", HORIZON, RADII, negatives=nothing)


def backtest_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tested(spark, sf_dir).withColumn("split", F.concat_ws("|", "model", "unit", "train"))
    each = validation.prediction_scores(rows, "split").withColumn("model", F.substring_index("split", "|", 1))
    pooled = validation.pooled_scores(each, "model")
    return pooled.select("model", "splits", *[units(F.col(c), 1e6).alias(f"{c}_e6") for c in ("precision", "recall", "f1", "jaccard", "brier")])


def missed_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts are the events of all detections, apart for each unit and split."""
    fronts = clustering.labelled(detections(spark, sf_dir), SPEED_KMH, HOURS)
    held = tested(spark, sf_dir).where("positive").join(fronts, "id").withColumn("front", F.struct("unit", "train", "event"))
    return validation.missed_fronts(held, "model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (backtest_pooled, missed_fronts)}


def oracle_sql() -> dict[str, str]:
    e6 = lambda x, n: f"{_units(f'({x})', '1e6')} AS {n}_e6"
    tp, fp, fn = "count(*) FILTER (p >= 5e-1 AND positive)", "count(*) FILTER (p >= 5e-1 AND NOT positive)", "count(*) FILTER (p < 5e-1 AND positive)"
    return {
        "backtest_pooled": f"WITH RECURSIVE {DETECTIONS_SQL}, {NEAREST} SELECT model, count(DISTINCT (unit, train)) AS splits, {e6(f'{tp} / nullif({tp} + {fp}, 0)', 'precision')}, {e6(f'{tp} / nullif({tp} + {fn}, 0)', 'recall')}, {e6(f'2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)', 'f1')}, {e6(f'{tp} / nullif({tp} + {fp} + {fn}, 0)', 'jaccard')}, {e6('avg(pow(p - CAST(positive AS INT), 2))', 'brier')} FROM z GROUP BY model",
        "missed_fronts": f"WITH RECURSIVE {LABELS_SQL}, {NEAREST}, f AS (SELECT model, unit, train, event, max(p) AS best FROM z JOIN l USING (id) WHERE positive GROUP BY ALL) SELECT model, count(*) AS fronts, count(*) FILTER (best < 5e-1) AS missed FROM f GROUP BY model",
    }
