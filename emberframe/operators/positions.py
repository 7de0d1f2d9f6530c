"""Live positions of units: latest report, track segments, interpolation, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import haversine_km

EARTH_KM = 6371.0088  #: the radius that position reports are measured with


def latest(reports: DataFrame) -> DataFrame:
    """The newest report of each unit; of equally new ones the largest id."""
    best = reports.groupBy("unit").agg(F.max_by(F.struct("id", "acq_ts", "latitude", "longitude"), F.struct("acq_ts", "id")).alias("r"))
    return best.select("unit", "r.*")


def steps(reports: DataFrame, gap_seconds: int, speed_kmh: float) -> DataFrame:
    """Each report with whether it starts a segment: after a gap, without time between, or after an implausible jump."""
    order = Window.partitionBy("unit").orderBy("acq_ts", "id")
    before = {f"last_{c}": F.lag(c).over(order) for c in ("acq_ts", "latitude", "longitude")}
    apart = F.col("acq_ts") - F.col("last_acq_ts")
    speed = haversine_km(F.col("last_latitude"), F.col("last_longitude"), F.col("latitude"), F.col("longitude"), EARTH_KM) / F.greatest(apart / 3600, F.lit(1e-9))
    return reports.withColumns(before).withColumn("starts", F.coalesce((apart > gap_seconds) | (apart <= 0) | (speed > speed_kmh), F.lit(True)))


def segments(reports: DataFrame, gap_seconds: int = 900, speed_kmh: float = 180.0) -> DataFrame:
    """unit, segment, n, first_ts, last_ts, first_id, kind (Point or LineString)."""
    order = Window.partitionBy("unit").orderBy("acq_ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = steps(reports, gap_seconds, speed_kmh).withColumn("segment", F.sum(F.col("starts").cast("long")).over(order))
    whole = numbered.groupBy("unit", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("acq_ts").alias("first_ts"), F.max("acq_ts").alias("last_ts"), F.min("id").alias("first_id"))
    return whole.withColumn("kind", F.when(F.col("n") == 1, "Point").otherwise("LineString"))


def interpolate(reports: DataFrame, at: int, gap_seconds: int) -> DataFrame:
    """Each unit's position at a time, between the reports on either side of it, if they are at most gap_seconds apart."""
    point = F.struct("acq_ts", "latitude", "longitude")
    sides = reports.groupBy("unit").agg(
        F.max_by(point, F.when(F.col("acq_ts") <= at, F.struct("acq_ts", "id"))).alias("p"), F.min_by(point, F.when(F.col("acq_ts") >= at, F.struct("acq_ts", "id"))).alias("q"),
    ).where("p IS NOT NULL AND q IS NOT NULL").where(F.col("q.acq_ts") - F.col("p.acq_ts") <= gap_seconds)
    span = F.col("q.acq_ts") - F.col("p.acq_ts")
    share = F.when(span > 0, (F.lit(at) - F.col("p.acq_ts")) / span).otherwise(F.lit(0.0))
    between = lambda c: (F.col(f"p.{c}") + (F.col(f"q.{c}") - F.col(f"p.{c}")) * share).alias(c)
    return sides.select("unit", span.alias("gap"), between("latitude"), between("longitude"))
