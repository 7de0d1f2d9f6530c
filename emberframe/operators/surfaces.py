"""Gridded surfaces in long form (cell by cell): heat, arrival, spread bands, probability mass, wind, fuel moisture."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import LATITUDE_KM, LONGITUDE_KM, footprint_km, haversine_km
from emberframe.session import shuffle_partitions

SIGMAS = 5.0  #: the reach of a detection's kernel, beyond which it adds less than 4e-6 of its weight
TILE = 64  #: rows and columns of a tile of cells
IN_TASK = 50_000  #: points whose cells one task works out, about
CELL = ("tile_row", "tile_col", "row", "col")
# fixed values of the weights
LEAST_SIGMA_M = 150.0
SENSOR, SENSOR_ELSE = {"VIIRS": 1.0, "MODIS": 0.7, "OLI": 0.9}, 0.6
CONFIDENCE, CONFIDENCE_ELSE = {"high": 1.0, "nominal": 0.7, "low": 0.35}, 0.5


def _lookup(value: Column, table: dict[str, float], other: float) -> Column:
    found = F.lit(other)
    for key, weight in table.items():
        found = F.when(value == key, weight).otherwise(found)
    return found


def near_cells(points: DataFrame, step: float, reach: Column) -> DataFrame:
    """points with every cell (row, col) of a grid of step degrees whose centre is at most reach km away, and km. The cells looked at follow from each row's own reach and latitude.

    Points are dealt by the tiles (CELL, the first two) that they reach before cells become rows, so whatever is summed by CELL stays in its task, and a task holds the cells of some tiles.
    """
    high, wide = reach / LATITUDE_KM, reach / (LONGITUDE_KM * F.greatest(F.cos(F.radians("latitude")), F.lit(1e-3)))
    ends = {f"__{end}{n}": F.floor((F.col(c) + sign * pad) / step) for end, c, pad in (("y", "latitude", high), ("x", "longitude", wide)) for n, sign in ((0, -1), (1, 1))}
    tiles = lambda end: F.explode(F.sequence(F.floor(F.col(f"__{end}0") / TILE), F.floor(F.col(f"__{end}1") / TILE)))
    around = lambda tile, end: F.explode(F.sequence(F.greatest(f"__{end}0", F.col(tile) * TILE), F.least(f"__{end}1", F.col(tile) * TILE + TILE - 1)))
    tasks = max(shuffle_partitions(points.sparkSession), -(-points.count() // IN_TASK))
    dealt = points.withColumns(ends).withColumn("tile_row", tiles("y")).withColumn("tile_col", tiles("x")).repartition(tasks, "tile_row", "tile_col")
    placed = dealt.withColumn("row", around("tile_row", "y")).withColumn("col", around("tile_col", "x")).drop(*ends)
    y, x = (F.col("row") + 0.5) * step, (F.col("col") + 0.5) * step
    km = F.hypot((F.col("longitude") - x) * LONGITUDE_KM * F.cos(F.radians("latitude")), (F.col("latitude") - y) * LATITUDE_KM)
    return placed.withColumn("km", km).where(F.col("km") <= reach)


def heat(detections: DataFrame, step: float, reference: int, tau_hours: float = 6.0, sigmas: float = SIGMAS) -> DataFrame:
    """row, col, heat: 1 less the product of what each detection leaves: weight, Gaussian kernel, age and radiative power."""
    sigma = F.greatest(F.lit(LEAST_SIGMA_M / 1000), footprint_km(F.col("scan"), F.col("track")))
    near = near_cells(detections.withColumn("sigma", sigma), step, sigmas * F.col("sigma"))
    age = F.greatest((F.lit(reference) - F.col("acq_ts")) / 3600, F.lit(0.0))
    boost = 1 + F.least(F.lit(1.5), F.log1p(F.greatest(F.coalesce("frp", F.lit(0.0)), F.lit(0.0))) / 6)
    weight = _lookup(F.col("instrument"), SENSOR, SENSOR_ELSE) * _lookup(F.col("confidence_level"), CONFIDENCE, CONFIDENCE_ELSE)
    part = F.greatest(F.lit(0.0), F.least(F.lit(0.999), weight * F.exp(-F.pow(F.col("km") / F.col("sigma"), F.lit(2.0)) / 2) * F.exp(-age / tau_hours) * boost))
    return near.groupBy(*CELL).agg((1 - F.exp(F.sum(F.log(1 - part)))).alias("heat")).select("row", "col", "heat")


def arrival(detections: DataFrame, step: float, reach_km: float, reference: int) -> DataFrame:
    """row, col, n, median, earliest, latest: the mean time of the detections within reach, weighed by the inverse square of the distance in metres, and one deviation to either side.

    The deviation is that of the differences from the mean: a mean of squares less the square of the mean loses what is small beside the time since the reference.
    """
    metres, since, cell = F.col("km") * 1000, F.col("acq_ts") - F.lit(reference), Window.partitionBy(*CELL)
    near = near_cells(detections, step, F.lit(reach_km)).select(*CELL, (1 / (metres * metres + 1e-6)).alias("w"), since.cast("double").alias("t"))
    near = near.withColumn("mean", F.sum(F.col("w") * F.col("t")).over(cell) / F.sum("w").over(cell))
    off = F.col("t") - F.col("mean")
    sums = near.groupBy(*CELL).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("w") * off * off) / F.sum("w")).alias("deviation"), F.count(F.lit(1)).alias("n"))
    mean, deviation = F.col("mean"), F.col("deviation")
    return sums.select("row", "col", "n", (mean + reference).alias("median"), (mean - deviation + reference).alias("earliest"), (mean + deviation + reference).alias("latest"))


def mass_levels(cells: DataFrame, by: str, shares: Sequence[float]) -> DataFrame:
    """Per group and share: the value down to which cells hold that share of all values, and how many cells reach it (ties included)."""
    values = cells.where("value > 0").groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("mass"))  # equal values at once
    down = Window.partitionBy(by).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    run = values.withColumns({"cells": F.sum("n").over(down), "upto": F.sum("mass").over(down), "whole": F.sum("mass").over(Window.partitionBy(by))})
    wanted = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return wanted.where(F.col("upto") >= F.col("share") * F.col("whole")).groupBy(by, "share").agg(F.max("value").alias("level"), F.min("cells").alias("cells"))


def spread_bands(passes: DataFrame, by: str, bands: int = 10) -> DataFrame:
    """Cumulative bands: up to so many cut-offs evenly spaced over a group's passes (last_ts each), and what share of the spread each is."""
    order = Window.partitionBy(by).orderBy("last_ts", "number")
    placed = passes.withColumns({"at": F.row_number().over(order) - 1, "count": F.count(F.lit(1)).over(Window.partitionBy(by))})
    k = F.least(F.col("count"), F.lit(bands))
    slots = F.explode(F.sequence(F.lit(0), (k - 1).cast("int")))
    places = placed.select(by, "count").distinct().withColumn("slot", slots)
    at = F.when(k == 1, F.lit(0)).otherwise(F.bround(F.col("slot") * (F.col("count") - 1) / (k - 1)))
    cut = places.withColumn("at", at.cast("long")).groupBy(by, "at").agg(F.min("slot").alias("slot"), F.first(k).alias("k"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("at")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(by))
    return cut.withColumns({"band": rank, "bands": total}).join(placed.select(by, "at", "last_ts"), [by, "at"]).select(by, "band", F.col("last_ts").alias("cutoff_ts"), (F.col("band") / F.greatest(F.lit(1), F.col("bands") - 1)).alias("fraction"))


def components(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """(u, v) of a wind that blows from a bearing."""
    return -speed * F.sin(F.radians(from_deg)), -speed * F.cos(F.radians(from_deg))


def meteorological(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed, bearing that it blows from) of a wind."""
    return F.hypot(u, v), F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def background(runs: DataFrame, by: str, at: int) -> DataFrame:
    """by, run_id, reference, u, v, stale: of each group's runs (run_id, reference, speed, from_deg, valid_until) the newest that isn't later than the time asked for and whose wind can be read."""
    known = runs.where((F.col("reference") <= at) & F.col("speed").isNotNull() & F.col("from_deg").isNotNull())
    best = known.groupBy(by).agg(F.max(F.struct("reference", "run_id", "speed", "from_deg", "valid_until")).alias("r")).select(by, "r.*")
    u, v = components(F.col("speed"), F.col("from_deg"))
    return best.select(by, "run_id", "reference", u.alias("u"), v.alias("v"), F.coalesce(F.col("valid_until") < at, F.lit(False)).alias("stale"))


def wind_field(points: DataFrame, observations: DataFrame, at: int, window_s: int, reach_km: float, run: DataFrame | None = None) -> DataFrame:
    """point_id, u, v, n, nearest_km, disagreement: vector mean of the observations in reach, by inverse square distance and half-life of age.

    run (point_id, u, v): a model's wind at each point. Observations then count by what they differ from it, and a point without any keeps
    it. Points and observations meet in cells of the size of the reach: an observation is in one, a point reaches into as many as its latitude asks for, across 180 degrees too.
    """
    columns = max(1, math.floor(360 / max(0.05, reach_km / 111.0)))
    size = 360 / columns  # whole cells around the globe
    turn = lambda x: F.pmod(x, F.lit(columns))
    u, v = components(F.col("speed"), F.col("from_deg"))
    seen = observations.where((F.col("observed") > at - window_s) & (F.col("observed") <= at)).select("lat", "lon", "observed", u.alias("ou"), v.alias("ov"), F.floor((F.col("lat") + 90) / size).alias("cy"), turn(F.floor((F.col("lon") + 180) / size)).alias("cx"))
    high = reach_km / 111.0
    wide = F.least(F.lit(180.0), F.lit(high) / F.cos(F.radians(F.least(F.lit(89.9), F.abs("plat") + high))))
    asked = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    asked = asked.withColumn("cy", F.explode(F.sequence(F.floor((F.col("plat") + 90 - high) / size), F.floor((F.col("plat") + 90 + high) / size))))
    west, east = F.floor((F.col("plon") + 180 - wide) / size), F.floor((F.col("plon") + 180 + wide) / size)
    asked = asked.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(west, F.least(east, west + columns - 1)), turn))))
    near = asked.join(seen, ["cy", "cx"]).withColumn("km", haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"), 6371.0088)).where(F.col("km") <= reach_km)
    if run is not None:  # observations by what they differ from the run
        base = points.select("point_id").join(run.select("point_id", "u", "v"), "point_id", "left")
        near = near.join(base, "point_id").withColumns({f"o{c}": F.col(f"o{c}") - F.coalesce(c, F.lit(0.0)) for c in ("u", "v")})
    half_life = max(900.0, window_s / 2)
    near = near.withColumn("w", F.pow(F.lit(0.5), (F.lit(at) - F.col("observed")) / half_life) / (F.col("km") * F.col("km") + 0.01))
    sums = [F.sum(e).alias(n) for n, e in (("w", F.col("w")), ("wu", F.col("w") * F.col("ou")), ("wv", F.col("w") * F.col("ov")), ("ws", F.col("w") * (F.col("ou") * F.col("ou") + F.col("ov") * F.col("ov"))))]
    whole = near.groupBy("point_id").agg(*sums, F.count(F.lit(1)).alias("n"), F.min("km").alias("nearest_km"))
    u, v = F.col("wu") / F.col("w"), F.col("wv") / F.col("w")
    told = whole.select("point_id", u.alias("du"), v.alias("dv"), "n", "nearest_km", F.sqrt(F.greatest(F.lit(0.0), F.col("ws") / F.col("w") - u * u - v * v)).alias("disagreement"))
    if run is None:
        return told.withColumnsRenamed({"du": "u", "dv": "v"})
    both = base.join(told, "point_id", "left").where("n IS NOT NULL OR u IS NOT NULL")
    total = lambda c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(f"d{c}", F.lit(0.0))
    return both.select("point_id", total("u").alias("u"), total("v").alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nearest_km", "disagreement")


def equilibrium_moisture(humidity_pct: Column, celsius: Column) -> Column:
    """The moisture (fraction) that dead fuel tends to in air of this humidity and temperature; saturated air counts as 99 %; null where either is missing."""
    share = F.least(F.lit(0.99), F.greatest(F.lit(0.0), humidity_pct / 100))
    dryness = F.greatest(F.lit(1e-9), -F.log(1 - share))
    value = F.greatest(F.lit(0.0), (F.lit(0.1617) - 0.001419 * celsius) * F.pow(dryness, F.lit(0.4657) - 0.003578 * celsius))
    return F.when(humidity_pct.isNotNull() & celsius.isNotNull(), value)


def moisture(hours: DataFrame, by: str, lags: Sequence[float] = (1.0, 10.0, 100.0), begin: Sequence[float] = (0.10, 0.12, 0.14), rain_mm: float = 0.5, rain_target: float = 0.35, bin_hours: int = 720) -> DataFrame:
    """by, one column per lag: dead fuel moisture after all hours (hour: a whole number, target, rain) in order, from `begin` on; rain draws to its target four times as fast (1 h at least); hours without a target change nothing, wet or not.

    An hour maps m to a * m + (1 - a) * target, and maps compose: the hours of a bin of bin_hours become one map by sums over
    the bin, and only bins, not hours, are gathered to a row: a window and a task hold a bin of a station at most.
    """
    wet = F.coalesce(F.col("rain"), F.lit(0.0)) >= rain_mm
    dealt = hours.where("target IS NOT NULL").select(by, F.floor(F.col("hour") / bin_hours).alias("bin"), "hour", F.when(wet, rain_target).otherwise(F.col("target")).alias("target"), wet.alias("wet"))
    rate = {lag: F.when(F.col("wet"), 1 / max(1.0, lag / 4)).otherwise(1 / lag) for lag in lags}
    later = Window.partitionBy(by, "bin").orderBy("hour").rowsBetween(1, Window.unboundedFollowing)
    rest = dealt.withColumns({f"r{i}": F.coalesce(F.sum(rate[lag]).over(later), F.lit(0.0)) for i, lag in enumerate(lags)})
    maps = [e for i, lag in enumerate(lags) for e in (F.exp(-F.sum(rate[lag])).alias(f"a{i}"), F.sum(F.col("target") * (1 - F.exp(-rate[lag])) * F.exp(-F.col(f"r{i}"))).alias(f"b{i}"))]
    bins = rest.groupBy(by, "bin").agg(*maps)
    series = bins.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("bin", *[f"{x}{i}" for i in range(len(lags)) for x in "ab"]))).alias("bins"))
    every = hours.select(by).distinct().join(series, by, "left")
    folded = lambda i: F.aggregate("bins", F.lit(float(begin[i])), lambda m, x: x[f"a{i}"] * m + x[f"b{i}"])
    return every.select(by, *[F.coalesce(folded(i), F.lit(float(begin[i]))).alias(f"m{int(lag)}") for i, lag in enumerate(lags)])
