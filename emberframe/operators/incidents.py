"""Incident operations: areas of interest, exposure, retention, imports, clear passes, burn severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: hours of the exposure buckets, thresholds of dNBR, weights of a clear pass
BUCKET_HOURS = (2, 6, 12, 24, 48)
SEVERITY = (0.10, 0.27, 0.66)
PASS_WEIGHT, LEAST_FACTOR, LEAST_CLARITY, CLOUD_GAP = 0.6, 0.05, 0.3, 7200
AOI_CELL = 0.1  #: degrees


def point_in_polygon(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over a closed ring of (x, y), half-open, so that a point on a shared edge is in one polygon alone."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i + 1).alias("q")))
    crosses = lambda e: ((e["p"]["y"] > lat) != (e["q"]["y"] > lat)) & (lon < (e["q"]["x"] - e["p"]["x"]) * (lat - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))


def covering(detections: DataFrame, areas: DataFrame) -> DataFrame:
    """Detections with the incident_id of each area (incident_id, ring) around them, met by the cells of the ring's extent."""
    span = lambda c: F.sequence(F.floor(F.array_min(F.col("ring")[c]) / AOI_CELL), F.floor(F.array_max(F.col("ring")[c]) / AOI_CELL))
    dealt = areas.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    placed = detections.withColumns({"cx": F.floor(F.col("longitude") / AOI_CELL), "cy": F.floor(F.col("latitude") / AOI_CELL)})
    return placed.join(dealt, ["cx", "cy"]).where(point_in_polygon(F.col("longitude"), F.col("latitude"), F.col("ring"))).drop("cx", "cy", "ring")


def aoi_watch(detections: DataFrame, areas: DataFrame) -> DataFrame:
    """incident_id, n, newest, sources of the detections in each area."""
    return covering(detections, areas).groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.max("acq_ts").alias("newest"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))


def bucket_of(hours: Column) -> Column:
    found = F.when(hours.isNull(), "not_reached").when(hours <= 0, "reached")
    for h in BUCKET_HOURS:
        found = found.when(hours <= h, f"within_{h}h")
    return found.otherwise("beyond_48h")


def exposure(structures: DataFrame) -> DataFrame:
    """structures (hours): a row for every bucket, also the empty ones."""
    every = structures.sparkSession.createDataFrame([(b,) for b in ("not_reached", "reached", *(f"within_{h}h" for h in BUCKET_HOURS), "beyond_48h")], "bucket string")
    counted = structures.groupBy(bucket_of(F.col("hours")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def retention(detections: DataFrame, members: DataFrame, cutoff: int) -> DataFrame:
    """Events (event, detection_id in members) that lose detections older than the cutoff but not all: their recomputed n, first_seen, last_seen."""
    joined = members.join(detections.select(F.col("id").alias("detection_id"), "acq_ts"), "detection_id")
    old = (F.col("acq_ts") < cutoff).cast("int")
    stays = lambda c: F.when(F.col("acq_ts") >= cutoff, F.col(c))
    found = joined.groupBy("event").agg(F.max(old).alias("loses"), F.count(stays("acq_ts")).alias("n"), F.min(stays("acq_ts")).alias("first_seen"), F.max(stays("acq_ts")).alias("last_seen"))
    return found.where("loses = 1 AND n > 0").drop("loses")


def classify_import(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """id, kind of each incoming row (id, revision, content): new, identical, incoming_newer, local_newer or divergent."""
    known = local.select("id", F.col("revision").alias("held"), F.col("content").alias("held_content"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "new").when(F.col("content").eqNullSafe(F.col("held_content")), "identical").when(F.col("revision") > F.col("held"), "incoming_newer").when(F.col("revision") < F.col("held"), "local_newer").otherwise("divergent")
    return incoming.join(known, "id", "left").select("id", kind.alias("kind"))


def clear_pass_factor(passes: DataFrame, clouds: DataFrame, key: str, reference: int, tau_hours: float) -> DataFrame:
    """key, factor: what the strongest of a key's clear passes (key, pass_ts) leaves. A pass counts less by age and by the nearest cloud hour
    (cloud_ts, percent) within CLOUD_GAP; of equally near hours the first. Hours are met in bins, so the join is an equi-join."""
    asked = passes.select(key, "pass_ts").distinct().withColumn("bin", F.floor(F.col("pass_ts") / CLOUD_GAP))
    hours = clouds.select("cloud_ts", "percent", F.explode(F.array(*[F.floor(F.col("cloud_ts") / CLOUD_GAP) + i for i in (-1, 0, 1)])).alias("bin"))
    apart = F.abs(F.col("cloud_ts") - F.col("pass_ts"))
    nearest = asked.join(hours, "bin").where(apart <= CLOUD_GAP).groupBy(key, "pass_ts").agg(F.min_by("percent", F.struct(apart, F.col("cloud_ts"))).alias("percent"))
    clarity = F.coalesce(F.greatest(F.lit(LEAST_CLARITY), 1 - F.col("percent") / 100), F.lit(1.0))
    age = F.greatest(F.lit(0.0), (F.lit(reference) - F.col("pass_ts")) / 3600)
    strongest = F.max(PASS_WEIGHT * F.exp(-age / tau_hours) * clarity)
    return asked.join(nearest, [key, "pass_ts"], "left").groupBy(key).agg(F.greatest(F.lit(LEAST_FACTOR), 1 - strongest).alias("factor"))


def severity(pre: Column, post: Column) -> Column:
    """Class of the drop of the burn ratio: 0 to 3, -1 without data."""
    drop = pre - post
    return F.when(drop.isNull() | F.isnan(drop), -1).when(drop < SEVERITY[0], 0).when(drop < SEVERITY[1], 1).when(drop < SEVERITY[2], 2).otherwise(3)


def burn_ratio(nir: Column, swir: Column) -> Column:
    return (nir - swir) / F.nullif(nir + swir, F.lit(0.0))
