"""Persistent industrial heat: matching detections with sources, stationarity, scores and the wildfire override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import haversine_km

CELL = 0.1  #: degrees of the cells in which detections and sources meet
# fixed values of the score
EVIDENCE, PERSISTENCE, STATIONARITY, RADIOMETRIC = 0.30, 0.30, 0.25, 0.15
PERSISTENT, AMBIGUOUS = 0.75, 0.45


def cell_of(degrees: Column) -> Column:
    return F.floor(degrees / CELL)


def match_nearest(detections: DataFrame, sources: DataFrame) -> DataFrame:
    """id, source_id, km: the nearest of sources (source_id, lat, lon, radius_km) within its own radius, ties to the smaller source_id.

    A source is met in as many cells as its radius and latitude need, so the join is an equi-join.
    """
    high = F.col("radius_km") / 111.0  # degrees of latitude, a little more than needed
    wide = F.least(F.lit(180.0), high / F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + high))))
    cells = lambda c, reach: F.explode(F.sequence(cell_of(F.col(c) - reach), cell_of(F.col(c) + reach)))
    turn = lambda x: F.pmod(x, F.lit(round(360 / CELL)))
    around = sources.withColumn("cy", cells("lat", high)).withColumn("cx", cells("lon", wide)).withColumn("cx", turn(F.col("cx")))
    placed = detections.select("id", "latitude", "longitude", cell_of(F.col("latitude")).alias("cy"), turn(cell_of(F.col("longitude"))).alias("cx"))
    met = placed.join(around, ["cy", "cx"]).withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))).where("km <= radius_km")
    return met.groupBy("id").agg(F.min(F.struct("km", "source_id")).alias("m")).select("id", "m.source_id", "m.km")


def stationarity(detections: DataFrame, key: str) -> DataFrame:
    """key, spread_km: per instrument the mean distance from its own centroid, of which the least counts."""
    centres = detections.groupBy(key, "instrument").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    spreads = detections.select(key, "instrument", "latitude", "longitude").join(centres, [key, "instrument"]).groupBy(key, "instrument").agg(F.avg(km).alias("km"))
    return spreads.groupBy(key).agg(F.min("km").alias("spread_km"))


def persistence(detections: DataFrame, key: str) -> DataFrame:
    """key, n, days, frp_median (the upper one), frp_spread (of the quartiles; from four detections on).

    Equal values are counted before a key's values meet, so a hot key costs its distinct values."""
    counted = detections.groupBy(key, "frp").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(key).orderBy("frp").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.where("frp IS NOT NULL").withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy(key)))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("all") * share / 4), F.col("frp")))
    quartiles = ranked.groupBy(key).agg(F.max("all").alias("values"), at(1).alias("q1"), at(2).alias("frp_median"), at(3).alias("q3"))
    whole = detections.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("acq_date").alias("days"))
    return whole.join(quartiles, key, "left").select(key, "n", "days", "frp_median", F.when(F.col("values") >= 4, F.col("q3") - F.col("q1")).alias("frp_spread"))


def score(known: DataFrame, strong: Column, window_days: int) -> DataFrame:
    """known (n, days, spread_km, frp_median, frp_spread) with score and classification."""
    evidence = F.when(strong, 1.0).otherwise(0.5)
    share = F.least(F.lit(1.0), F.col("days") / F.lit(float(max(1, window_days))))
    still = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("spread_km") / 2), F.lit(0.0))
    steady = F.when((F.col("frp_median") != 0) & F.col("frp_spread").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("frp_spread") / (F.col("frp_median") + 1e-6)))).otherwise(0.5)
    total = F.round(F.least(F.lit(1.0), EVIDENCE * evidence + PERSISTENCE * share + STATIONARITY * still + RADIOMETRIC * steady), 4)
    kind = F.when(F.col("n") == 0, "insufficient_evidence").when(F.col("score") >= PERSISTENT, "persistent_industrial").when(F.col("score") >= AMBIGUOUS, "ambiguous").otherwise("insufficient_evidence")
    return known.withColumn("score", total).withColumn("classification", kind)


def overrides(detections: DataFrame, matches: DataFrame, sources: DataFrame, event: str) -> DataFrame:
    """event, source_id, matched, downgraded: whether the event's last third by time lies beyond twice the radius of a source that it matched
    and beyond 1.5 times its first third's reach. Events of fewer than four detections are never downgraded."""
    order = Window.partitionBy(event).orderBy("acq_ts", "id")
    ranked = detections.select(event, "id", "latitude", "longitude", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(event)).alias("n"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    ends = ranked.withColumns({"early": F.col("rank") <= third, "late": F.col("rank") > F.col("n") - third}).where("early OR late")
    pairs = matches.join(detections.select("id", event), "id").groupBy(event, "source_id").agg(F.count(F.lit(1)).alias("matched")).join(sources, "source_id")
    far = ends.join(pairs, event).withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")))
    reach = far.groupBy(event, "source_id", "matched", "radius_km", "n").agg(*(F.max(F.when(F.col(side), F.col("km"))).alias(side) for side in ("early", "late")))
    return reach.select(event, "source_id", "matched", ((F.col("n") >= 4) & (F.col("late") > F.col("radius_km") * 2) & (F.col("late") > F.col("early") * 1.5)).alias("downgraded"))
