"""Fire events: the space-time pair graph of detections, its components, their summaries, passes and coverage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import LATITUDE_KM, LONGITUDE_KM, footprint_km
from emberframe.session import cut


def space_time_pairs(detections: DataFrame, speed_kmh: float, hours: float) -> DataFrame:
    """(a, b), a < b: detections at most hours apart whose distance is no more than their radii and what speed_kmh makes of the time between.

    Each detection is met in its own cell and time bin and the neighbouring ones, so the join is an equi-join. Both sides are shuffled:
    by the size of their files alone, small for what they hold, detections would be gathered in the driver for a broadcast.
    """
    reach = detections.agg(F.avg("latitude").alias("lat"), F.max(footprint_km(F.col("scan"), F.col("track"))).alias("r")).first()
    if reach["lat"] is None:
        return detections.sparkSession.createDataFrame([], "a long, b long")
    side = 2 * reach["r"] + speed_kmh * hours
    x, y = F.col("longitude") * (LONGITUDE_KM * math.cos(math.radians(reach["lat"]))), F.col("latitude") * LATITUDE_KM
    placed = detections.select("id", "acq_ts", x.alias("x"), y.alias("y"), footprint_km(F.col("scan"), F.col("track")).alias("r"))
    cells = [F.floor(F.col("x") / side), F.floor(F.col("y") / side), F.floor(F.col("acq_ts") / (hours * 3600))]
    near = placed.withColumns({n: F.explode(F.array(*[c + i for i in (-1, 0, 1)])) if n == "cx" else c for n, c in zip(("cx", "cy", "ct"), cells, strict=True)})
    near = near.withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-1, 0, 1)]))).withColumn("ct", F.explode(F.array(*[F.col("ct") + i for i in (-1, 0, 1)])))
    one = near.select("cx", "cy", "ct", *[F.col(c).alias(f"{c}_a") for c in placed.columns])
    two = placed.select(*[c.alias(n) for n, c in zip(("cx", "cy", "ct"), cells, strict=True)], *[F.col(c).alias(f"{c}_b") for c in placed.columns])
    apart = F.abs(F.col("acq_ts_a") - F.col("acq_ts_b")) / 3600
    distance = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    linked = (F.col("id_a") < F.col("id_b")) & (apart <= hours) & (distance <= F.col("r_a") + F.col("r_b") + speed_kmh * apart)
    return one.join(two.hint("merge"), ["cx", "cy", "ct"]).where(linked).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, event (the smallest id that can be reached) by least labels and pointer jumping, until nothing changes."""
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(ids.select("id", F.col("id").alias("event")))
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("event").alias("near"))
        hop = labels.select(F.col("id").alias("event"), F.col("event").alias("further"))
        moved = labels.join(around, "id", "left").join(hop, "event").select("id", F.least("event", "near", "further").alias("least"), "event")
        moved = cut(moved.select("id", F.col("least").alias("event"), (F.col("least") < F.col("event")).alias("changed")))
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels


def summaries(detections: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """A row per event of at least so many detections: bounds, time span, sorted sources."""
    whole = detections.join(labels, "id").groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.min("acq_ts").alias("first_seen"), F.max("acq_ts").alias("last_seen"), F.min("longitude").alias("west"), F.max("longitude").alias("east"),
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"),
    )
    return whole.where(F.col("n") >= least)


def passes(detections: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Overpasses of each satellite: runs of detections with gaps of at most gap_seconds, numbered by time.

    Runs are found within each satellite's days and go on across midnight where the gap allows, so a window holds a day's detections, and then the runs.
    """
    by_day = detections.select("satellite", "acq_ts", F.floor(F.col("acq_ts") / 86_400).alias("day")).groupBy("satellite", "day", "acq_ts").agg(F.count(F.lit(1)).alias("same"))
    order = Window.partitionBy("satellite", "day").orderBy("acq_ts")
    starts = F.coalesce((F.col("acq_ts") - F.lag("acq_ts").over(order) > gap_seconds).cast("int"), F.lit(1))
    numbered = by_day.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("satellite", "day", "run").agg(F.min("acq_ts").alias("a"), F.max("acq_ts").alias("b"), F.sum("same").alias("n"))
    after = Window.partitionBy("satellite").orderBy("a")
    begins = F.coalesce((F.col("a") - F.lag("b").over(after) > gap_seconds).cast("int"), F.lit(1))
    stitched = runs.withColumn("begins", begins).withColumn("number", F.sum("begins").over(after.rowsBetween(Window.unboundedPreceding, 0)))
    return stitched.groupBy("satellite", "number").agg(F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.sum("n").alias("n"))


def day_islands(days: DataFrame, most: int, keys: Sequence[str] = ("source",), day: str = "acq_date") -> DataFrame:
    """Runs of successive days of each key, cut after most days: the keys, first_day, last_day, days."""
    order = Window.partitionBy(*keys).orderBy(day)
    placed = days.select(*keys, day).distinct().withColumn("island", F.date_sub(day, F.row_number().over(order)))
    within = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(day)) - 1
    return placed.withColumn("chunk", F.floor(within / most)).groupBy(*keys, "island", "chunk").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island", "chunk")


def missing_days(seen: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("source", "acq_date")) -> DataFrame:
    """Of the wanted keys those that haven't been seen."""
    return wanted.join(seen.select(*keys).distinct(), list(keys), "left_anti")
