"""Backtests: expanding holdout splits, growth fits, scores of predictions, weighted percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import LATITUDE_KM, LONGITUDE_KM, haversine_km


def holdout_splits(detections: DataFrame, event: str, splits: int = 5, least: int = 8) -> DataFrame:
    """event, train, holdout (counts), split_ts, target_ts: at most so many splits, evenly spread, each trained on the earliest detections."""
    order = Window.partitionBy(event).orderBy("acq_ts", "id")
    ranked = detections.select(event, "acq_ts", F.row_number().over(order).cast("long").alias("train"), F.lead("acq_ts").over(order).alias("target_ts"), F.count(F.lit(1)).over(Window.partitionBy(event)).alias("n"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - least) / splits))
    after = F.col("train") - least
    chosen = ranked.where((after >= 0) & (F.col("train") < F.col("n")) & (F.pmod(after, step) == 0) & (after < step * splits))
    return chosen.select(event, "train", (F.col("n") - F.col("train")).alias("holdout"), F.col("acq_ts").alias("split_ts"), "target_ts")


def growth(detections: DataFrame, event: str) -> DataFrame:
    """event, start_km, km_per_s: distance from the centroid as a line over time, both floored at 0; the largest distance and 0 where time stands still."""
    centres = detections.groupBy(event).agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.min("acq_ts").alias("t0"))
    x, y = (F.col("longitude") - F.col("lon")) * LONGITUDE_KM * F.cos(F.radians("lat")), (F.col("latitude") - F.col("lat")) * LATITUDE_KM
    points = detections.select(event, "latitude", "longitude", "acq_ts").join(centres, event).select(event, F.hypot(x, y).alias("km"), (F.col("acq_ts") - F.col("t0")).cast("double").alias("t"))
    fit = points.groupBy(event).agg(F.regr_slope("km", "t").alias("b"), F.regr_intercept("km", "t").alias("a"), F.max("km").alias("most"), F.max("t").alias("span"))
    moving = F.col("span") > 0
    return fit.select(event, F.when(moving, F.greatest(F.lit(0.0), F.col("a"))).otherwise(F.col("most")).alias("start_km"), F.when(moving, F.greatest(F.lit(0.0), F.col("b"))).otherwise(0.0).alias("km_per_s"))


def prediction_scores(points: DataFrame, model: str, threshold: float = 0.5) -> DataFrame:
    """points (model, probability, positive): counts, precision, recall, f1, jaccard (null without a denominator) and Brier score of each model."""
    said, true = F.col("probability") >= threshold, F.col("positive")
    counts = {"tp": said & true, "fp": said & ~true, "fn": ~said & true, "tn": ~said & ~true}
    error = F.col("probability") - true.cast("double")
    found = points.groupBy(model).agg(*(F.sum(c.cast("long")).alias(n) for n, c in counts.items()), F.avg(error * error).alias("brier"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return found.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "jaccard": ratio(tp, tp + fp + fn)})


def weighted_percentiles(values: DataFrame, key: str, percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """values (key, value, weight): the first value whose cumulated weight reaches each percentage. Equal values are added up first."""
    whole = values.groupBy(key, "value").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = whole.withColumn("upto", F.sum("weight").over(order)).withColumn("all", F.sum("weight").over(Window.partitionBy(key)))
    return placed.groupBy(key).agg(*(F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("value"))).alias(f"p{p}") for p in percents))


def effective_members(weights: DataFrame, key: str) -> DataFrame:
    """weights (key, log_weight): n and the effective sample size of the normalised weights. The largest is subtracted before exponentials are taken."""
    top = weights.groupBy(key).agg(F.max("log_weight").alias("top"))
    w = F.exp(F.col("log_weight") - F.col("top"))
    return weights.join(top, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)).alias("effective"))


def tile_of(zoom: int, clamped: bool = True):
    """(x, y) of the slippy map tile of latitude, longitude at this zoom; clamped to the map, or counted on beyond 180 degrees east and west."""
    n = 1 << zoom
    lat = F.radians(F.least(F.greatest(F.col("latitude"), F.lit(-85.05112878)), F.lit(85.05112878)))
    x = F.floor((F.col("longitude") + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n)
    on_map = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("long")
    return on_map(x) if clamped else x.cast("long"), on_map(y)


def pooled_scores(splits: DataFrame, model: str) -> DataFrame:
    """model, splits, precision, recall, f1, jaccard, brier: of rows per split (tp, fp, fn, tn, brier), from counts summed over all splits, and the Brier score weighted by their points.

    A mean of ratios would agree with none of them; a ratio without a denominator is null. Splits without a Brier score don't count for it.
    """
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    sums = splits.groupBy(model).agg(F.count(F.lit(1)).alias("splits"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum(F.col("brier") * n).alias("e"), F.sum(F.when(F.col("brier").isNotNull(), n)).alias("n"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return sums.select(model, "splits", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("jaccard"), ratio(F.col("e"), F.col("n")).alias("brier"))


def missed_fronts(holdout: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """by, fronts, missed: of held-out detections (by, front, probability) how many fronts there are, and how many have no member that the model gave the threshold at least."""
    best = holdout.groupBy(by, "front").agg(F.max(F.coalesce("probability", F.lit(0.0))).alias("best"))
    return best.groupBy(by).agg(F.count(F.lit(1)).alias("fronts"), F.sum((F.col("best") < threshold).cast("long")).alias("missed"))


def nearest_training(holdout: DataFrame, detections: DataFrame, event: str, reach_km: float) -> DataFrame:
    """holdout (event, split, id, ...) with km: the distance to the nearest detection of its event that the split trains on, null beyond reach_km.

    Training rows are those up to the split's time, so nothing later changes a prediction. Rows meet in cells of the reach, by latitude and across 180 degrees.
    """
    columns = max(1, math.floor(360 / max(1e-3, reach_km / 111.0)))
    size = 360 / columns
    turn = lambda x: F.pmod(x, F.lit(columns))
    seen = detections.select(F.col(event).alias("__event"), F.col("acq_ts").alias("__ts"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), F.floor((F.col("latitude") + 90) / size).alias("__cy"), turn(F.floor((F.col("longitude") + 180) / size)).alias("__cx"))
    high = reach_km / 111.0
    wide = F.least(F.lit(180.0), F.lit(high) / F.cos(F.radians(F.least(F.lit(89.9), F.abs("latitude") + high))))
    tall = holdout.withColumn("__y", F.explode(F.sequence(F.floor((F.col("latitude") + 90 - high) / size), F.floor((F.col("latitude") + 90 + high) / size))))
    west, east = F.floor((F.col("longitude") + 180 - wide) / size), F.floor((F.col("longitude") + 180 + wide) / size)
    asked = tall.withColumn("__x", F.explode(F.array_distinct(F.transform(F.sequence(west, F.least(east, west + columns - 1)), turn))))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"))
    met = asked.join(seen, (F.col(event) == F.col("__event")) & (F.col("__cy") == F.col("__y")) & (F.col("__cx") == F.col("__x")) & (F.col("__ts") <= F.col("split_ts")))
    found = met.withColumn("km", km).where(F.col("km") <= reach_km).groupBy(event, "train", "id").agg(F.min("km").alias("km"))
    return holdout.join(found, [event, "train", "id"], "left")


def backtest(detections: DataFrame, event: str, horizon_s: int, radius_km: dict[str, float], splits: int = 5, negatives: DataFrame | None = None) -> DataFrame:
    """A row per event, split, model and point within horizon_s after the split: id, positive, probability (1 within the model's radius of a training detection, else 0).

    Points are held-out detections and negatives (event, id, acq_ts, latitude, longitude; ids apart from those of detections), where a look saw nothing. The splits of an event
    fan out to its later points, and those to the models; one search for the nearest training detection serves all models.
    """
    names = (event, "id", "acq_ts", "latitude", "longitude")
    points = detections.select(*names, F.lit(True).alias("positive"))
    if negatives is not None:
        points = points.unionByName(negatives.select(*names, F.lit(False).alias("positive")))
    chosen = holdout_splits(detections, event, splits).select(event, "train", "split_ts")
    late = chosen.join(points, event).where((F.col("acq_ts") > F.col("split_ts")) & (F.col("acq_ts") <= F.col("split_ts") + horizon_s))
    placed = nearest_training(late, detections, event, max(radius_km.values()))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(r)).alias("radius")) for m, r in radius_km.items()]))
    each = placed.withColumn("m", models)
    return each.select(event, "train", "id", "positive", "m.model", F.coalesce((F.col("km") <= F.col("m.radius")).cast("double"), F.lit(0.0)).alias("probability"))
