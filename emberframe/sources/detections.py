"""Detections: the view of the events table, and normalisation of raw confidence values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.session import table


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, instrument, satellite, latitude, longitude, acq_ts (epoch seconds), acq_date, scan, track, confidence_pct, confidence_level, frp, daynight."""
    kind, user, i = F.col("event_type"), F.col("user_id"), F.col("event_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    percent = F.get_json_object("props", "$.k").cast("int")
    source = F.when(kind.isin("click", "view"), "VIIRS_NOAA20_NRT").when(kind == "purchase", "VIIRS_SNPP_NRT").otherwise("MODIS_NRT")
    rows = table(spark, sf_dir, "events").select(
        i.cast("long").alias("id"), source.alias("source"), F.when(kind.isin("click", "view", "purchase"), "VIIRS").otherwise("MODIS").alias("instrument"),
        F.element_at(F.array(F.lit("N20"), F.lit("N"), F.lit("T")), (i % 3 + 1).cast("int")).alias("satellite"),
        (F.lit(36e0) + (user % 12).cast("double") * 7.5e-1 + ((i * 37) % 101).cast("double") * 5e-4).alias("latitude"),
        (F.lit(10e0) + F.floor(user / F.lit(12e0)).cast("double") * 9e-1 + ((i * 53) % 97).cast("double") * 6e-4).alias("longitude"),
        seconds.alias("acq_ts"), F.col("ts").cast("date").alias("acq_date"), (F.lit(3e-1) + (i % 5).cast("double") * 1e-1).alias("scan"),
        (F.lit(3e-1) + (i % 3).cast("double") * 1e-1).alias("track"), percent.alias("confidence_pct"), F.col("value").alias("frp"), user.cast("long").alias("unit"),
        F.when(F.hour(F.col("ts")).between(6, 17), "D").otherwise("N").alias("daynight"),
    )
    return rows.withColumn("confidence_level", level_of(F.col("confidence_pct")))


def level_of(percent: Column) -> Column:
    return F.when(percent < 30, "low").when(percent < 80, "nominal").when(percent.isNotNull(), "high")


def normalise_confidence(raw: Column) -> tuple[Column, Column]:
    """(percent, level) of a raw value: a number is truncated, a letter l, n or h names the level, another one is nominal, nothing is null."""
    text = F.lower(F.trim(raw))
    percent = F.try_cast(text, "double").cast("int") if hasattr(F, "try_cast") else text.try_cast("double").cast("int")
    letter = F.when(F.substring(text, 1, 1) == "l", "low").when(F.substring(text, 1, 1) == "h", "high").otherwise("nominal")
    return percent, F.when(text != "", F.coalesce(level_of(percent), letter))


DETECTIONS_SQL = r"""
d AS (
  SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'VIIRS_NOAA20_NRT' WHEN event_type = 'purchase' THEN 'VIIRS_SNPP_NRT' ELSE 'MODIS_NRT' END AS source,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'VIIRS' ELSE 'MODIS' END AS instrument, ['N20', 'N', 'T'][event_id % 3 + 1] AS satellite,
    36e0 + CAST(user_id % 12 AS DOUBLE) * 75e-2 + CAST((event_id * 37) % 101 AS DOUBLE) * 5e-4 AS latitude,
    10e0 + CAST(floor(user_id / 12e0) AS DOUBLE) * 9e-1 + CAST((event_id * 53) % 97 AS DOUBLE) * 6e-4 AS longitude,
    CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS acq_ts, CAST(ts AS DATE) AS acq_date, 3e-1 + CAST(event_id % 5 AS DOUBLE) * 1e-1 AS scan, 3e-1 + CAST(event_id % 3 AS DOUBLE) * 1e-1 AS track,
    CAST(json_extract_string(props, '$.k') AS INT) AS confidence_pct, value AS frp, CAST(user_id AS BIGINT) AS unit, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight,
    CASE WHEN confidence_pct < 30 THEN 'low' WHEN confidence_pct < 80 THEN 'nominal' WHEN confidence_pct IS NOT NULL THEN 'high' END AS confidence_level
  FROM events
)
"""
