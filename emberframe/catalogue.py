"""Queries of the wildfire operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import in_bbox
from emberframe.operators import clustering, events, positions
from emberframe.session import table
from emberframe.sources.detections import DETECTIONS_SQL, detections, normalise_confidence

SPEED_KMH, HOURS = 2.0, 6.0  #: of the compared pair graph
SPAN_KM = 4.0  #: of its events
AT = 1_705_000_000  #: a time within the events table
RING = "a.id < b.id AND abs(a.acq_ts - b.acq_ts) <= 21600 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= a.r + b.r + 2e0 * (abs(a.acq_ts - b.acq_ts) / 36e2)"
PAIRS_SQL = f"""{DETECTIONS_SQL}, m AS (SELECT avg(latitude) AS lat FROM d), p AS (
  SELECT id, acq_ts, longitude * (11132e-2 * cos(radians(m.lat))) AS x, latitude * 110574e-3 AS y, sqrt(scan * scan + track * track) / 2e0 AS r FROM d, m
), e AS (SELECT a.id AS a, b.id AS b FROM p AS a JOIN p AS b ON {RING})"""
LABELS_SQL = f"""{PAIRS_SQL}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (
  SELECT id, id AS reached FROM d UNION SELECT w.id, u.b FROM w JOIN u ON w.reached = u.a
), l AS (SELECT id, min(reached) AS event FROM w GROUP BY id)"""

BOX_SQL = "min(latitude) OVER w AS y0, max(latitude) OVER w AS y1, min(longitude + 360 * floor((lon0 - longitude + 180) / 360)) OVER w AS x0, max(longitude + 360 * floor((lon0 - longitude + 180) / 360)) OVER w AS x1"
DIAGONAL_SQL = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(y1 - y0) / 2), 2e0) + cos(radians(y0)) * cos(radians(y1)) * pow(sin(radians(x1 - x0) / 2), 2e0))))"
PIECES_SQL = f"""{LABELS_SQL}, s AS (
  SELECT d.id, l.event, CAST(1 AS BIGINT) AS path, 0 AS level, latitude, longitude FROM d JOIN l USING (id)
  UNION ALL
  SELECT id, event, path * 2 + CAST(CASE WHEN (x1 - x0) * 11132e-2 * cos(radians(lat0)) >= (y1 - y0) * 110574e-3 THEN longitude + 360 * floor((lon0 - longitude + 180) / 360) >= (x0 + x1) / 2 ELSE latitude >= (y0 + y1) / 2 END AS BIGINT), level + 1, latitude, longitude
  FROM (SELECT *, {BOX_SQL} FROM (SELECT *, avg(latitude) OVER v AS lat0, degrees(atan2(avg(sin(radians(longitude))) OVER v, avg(cos(radians(longitude))) OVER v)) AS lon0 FROM s WINDOW v AS (PARTITION BY event, path)) AS q WINDOW w AS (PARTITION BY event, path)) AS b
  WHERE level < 20 AND {DIAGONAL_SQL} > {SPAN_KM}
), f AS (SELECT id, event, arg_max(path, level) AS path FROM s GROUP BY id, event), n AS (SELECT id, min(id) OVER (PARTITION BY event, path) AS event FROM f)"""


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detections(spark, sf_dir).where(in_bbox(F.col("latitude"), F.col("longitude"), 10.0, 37.0, 19.0, 43.0) & (F.col("source") != "MODIS_NRT"))
    return seen.groupBy("acq_date").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("frp").cast("decimal(18,4)")), F.lit(0)).cast("double").alias("frp_total"))


def detections_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detections(spark, sf_dir).where((F.col("acq_ts") <= AT) & F.col("confidence_level").isin("nominal", "high") & (F.col("frp") >= 20) & (F.col("daynight") == "D"))
    return seen.orderBy(F.desc("acq_ts"), F.desc("id")).limit(500).select("id", "source", "latitude", "longitude", "acq_ts", "frp")


def detections_antimeridian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where(in_bbox(F.col("latitude"), F.col("longitude"), 19.0, 36.0, 11.0, 44.0)).select("id", "longitude")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("acq_ts").alias("oldest"), F.max("acq_ts").alias("newest"))


def confidence_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.substring(F.col("event_type"), 1, 1)).when(i % 4 == 1, F.lit("")).when(i % 4 == 2, F.lit(" H ")).otherwise(F.get_json_object("props", "$.k"))
    percent, level = normalise_confidence(raw)
    return table(spark, sf_dir, "events").select(i.alias("id"), percent.alias("percent"), level.alias("level"))


def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key (source, unit, day) overwrite one another in the order of their ids."""
    best = F.max_by(F.struct("id", "acq_ts", "frp"), "id").alias("r")
    return detections(spark, sf_dir).groupBy("source", "unit", "acq_date").agg(best).select("source", "unit", "acq_date", "r.*")


def coverage_day_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.day_islands(detections(spark, sf_dir), 5)


def coverage_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a range that a source hasn't seen a unit's cell on, for every source and unit."""
    seen = detections(spark, sf_dir)
    days = spark.sql("SELECT explode(sequence(DATE'2023-12-25', DATE'2024-02-05')) AS acq_date")
    return events.missing_days(seen, seen.select("source", "unit").distinct().crossJoin(F.broadcast(days)), ["source", "unit", "acq_date"])  # 43 days


def space_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.space_time_pairs(detections(spark, sf_dir), SPEED_KMH, HOURS)


def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.labelled(detections(spark, sf_dir), SPEED_KMH, HOURS)


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detections(spark, sf_dir)
    return events.summaries(seen, clustering.labelled(seen, SPEED_KMH, HOURS), 3)


def event_span_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components halved until no piece's box has a diagonal above SPAN_KM; links reach farther than that here."""
    seen = detections(spark, sf_dir)
    return clustering.split(seen.select("id", "latitude", "longitude").join(clustering.labelled(seen, SPEED_KMH, HOURS), "id"), SPAN_KM)


def event_span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of an event: box, centroid, times, sources and whether it is too wide."""
    seen = detections(spark, sf_dir)
    told = clustering.described(seen, event_span_bounded(spark, sf_dir), SPAN_KM)
    # averages and great circles to a fixed place, so that the order of summing doesn't show
    return told.withColumns({c: F.floor(F.col(c) * 1e6 + 0.37).cast("long") for c in ("centroid_lat", "centroid_lon", "span_km")})


def overpass_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.passes(detections(spark, sf_dir))


def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.latest(detections(spark, sf_dir))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.segments(detections(spark, sf_dir), 36_000)


def position_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.interpolate(detections(spark, sf_dir), AT, 86_400)


def clear_pass_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly passes without a detection within 1800 s, joined by half-hour bins."""
    hits = detections(spark, sf_dir).select("acq_ts", F.explode(F.array(*[F.floor(F.col("acq_ts") / 1800) + i for i in (-1, 0, 1)])).alias("bin"))
    times = spark.range(1_704_067_200, 1_706_659_200, 1800).select(F.col("id").alias("pass_ts"), F.floor(F.col("id") / 1800).alias("bin"))
    return times.join(hits, (times["bin"] == hits["bin"]) & (F.abs(times["pass_ts"] - hits["acq_ts"]) <= 1800), "left_anti").select("pass_ts")


def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.radians((F.col("id") * 37 % 360).cast("double"))
    mean = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
    # whole hundredths, so that the order of summing doesn't show
    return detections(spark, sf_dir).groupBy("unit").agg(F.floor(F.pmod(mean + 360, F.lit(360.0)) * 100 + 0.37).cast("long").alias("hundredths"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    left = orders.where("o_orderkey % 10 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("left_status"))
    right = orders.where("o_orderkey % 10 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("right_status"))
    kind = F.when(F.col("left_status").isNull(), "added").when(F.col("right_status").isNull(), "removed").when(F.col("left_status") == F.col("right_status"), "identical").otherwise("changed")
    return left.join(right, "o_orderkey", "full_outer").select("o_orderkey", kind.alias("kind"))


def industrial_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per half-degree cell: detections, distinct days, span, upper median of frp, quartile range from four on, day to night ratio."""
    cell = [F.floor(F.col(c) * 2).cast("long").alias(n) for c, n in (("latitude", "cell_y"), ("longitude", "cell_x"))]
    seen = detections(spark, sf_dir).select("*", *cell)
    night = F.sum((F.col("daynight") == "N").cast("long"))
    found = seen.groupBy("cell_y", "cell_x").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("acq_date").alias("days"), F.datediff(F.max("acq_date"), F.min("acq_date")).cast("long").alias("span"), (F.sum((F.col("daynight") == "D").cast("long")) / F.nullif(night, F.lit(0))).alias("day_night"),
    )
    # equal values first, so that a cell is as many rows as it has distinct values
    upto = Window.partitionBy("cell_y", "cell_x").orderBy("frp").rowsBetween(Window.unboundedPreceding, 0)
    values = seen.groupBy("cell_y", "cell_x", "frp").agg(F.count(F.lit(1)).alias("same")).withColumn("upto", F.sum("same").over(upto)).join(found.select("cell_y", "cell_x", "n"), ["cell_y", "cell_x"])
    at = lambda place: F.min(F.when(F.col("upto") > F.floor(place), F.col("frp")))
    quartiles = values.groupBy("cell_y", "cell_x").agg(at(F.col("n") / 2).alias("frp_median"), F.when(F.max("n") >= 4, at(F.col("n") * 3 / 4) - at(F.col("n") / 4)).alias("frp_spread"))
    return found.join(quartiles, ["cell_y", "cell_x"])


def telemetry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in arrival order (id) that are older than the newest one before them."""
    arrival = Window.partitionBy("unit").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    arrived = detections(spark, sf_dir).withColumn("observed", F.col("acq_ts") - (F.col("id") % 13) * 3000)
    return arrived.withColumn("newest", F.max("observed").over(arrival)).select("id", "unit", F.coalesce(F.col("observed") < F.col("newest"), F.lit(False)).alias("out_of_order"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        daily_activity, detections_filter_topk, detections_antimeridian_filter, source_stats, confidence_normalised, upsert_latest_wins, coverage_day_islands, coverage_missing_days, space_time_pairs,
        event_components, event_summary, event_span_bounded, event_span_summary, overpass_passes, latest_positions, track_segments, position_interpolate, clear_pass_anti_join, circular_mean, snapshot_diff, industrial_persistence, telemetry_flags,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    d = f"WITH RECURSIVE {DETECTIONS_SQL}"
    order = "OVER (PARTITION BY unit ORDER BY acq_ts, id)"
    half = lambda x: f"pow(sin({x} / 2), 2e0)"
    distance = f"2 * 63710088e-4 * asin(least(1e0, sqrt({half('radians(latitude - lat)')} + cos(radians(lat)) * cos(radians(latitude)) * {half('radians(longitude - lon)')})))"
    return {
        "daily_activity": f"{d} SELECT acq_date, count(*) AS n, CAST(coalesce(sum(CAST(frp AS DECIMAL(18, 4))), 0) AS DOUBLE) AS frp_total FROM d WHERE latitude BETWEEN 37 AND 43 AND longitude BETWEEN 10 AND 19 AND source <> 'MODIS_NRT' GROUP BY 1",
        "detections_filter_topk": f"{d} SELECT id, source, latitude, longitude, acq_ts, frp FROM d WHERE acq_ts <= {AT} AND confidence_level IN ('nominal', 'high') AND frp >= 20 AND daynight = 'D' ORDER BY acq_ts DESC, id DESC LIMIT 500",
        "detections_antimeridian_filter": f"{d} SELECT id, longitude FROM d WHERE latitude BETWEEN 36 AND 44 AND (longitude >= 19 OR longitude <= 11)",
        "source_stats": f"{d} SELECT source, count(*) AS n, min(acq_ts) AS oldest, max(acq_ts) AS newest FROM d GROUP BY source",
        "confidence_normalised": """WITH r AS (SELECT event_id AS id, lower(trim(CASE event_id % 4 WHEN 0 THEN event_type[1] WHEN 1 THEN '' WHEN 2 THEN ' H ' ELSE json_extract_string(props, '$.k') END)) AS raw FROM events),
            p AS (SELECT *, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INT) AS percent FROM r)
            SELECT id, percent, CASE WHEN raw <> '' THEN CASE WHEN percent < 30 THEN 'low' WHEN percent < 80 THEN 'nominal' WHEN percent IS NOT NULL THEN 'high' WHEN raw[1] = 'l' THEN 'low' WHEN raw[1] = 'h' THEN 'high' ELSE 'nominal' END END AS level FROM p""",
        "upsert_latest_wins": f"{d} SELECT source, unit, acq_date, id, acq_ts, frp FROM d QUALIFY row_number() OVER (PARTITION BY source, unit, acq_date ORDER BY id DESC) = 1",
        "coverage_day_islands": f"""{d}, g AS (SELECT DISTINCT source, acq_date FROM d), i AS (SELECT *, acq_date - CAST(row_number() OVER (PARTITION BY source ORDER BY acq_date) AS INT) AS island FROM g),
            c AS (SELECT *, (row_number() OVER (PARTITION BY source, island ORDER BY acq_date) - 1) // 5 AS chunk FROM i) SELECT source, min(acq_date) AS first_day, max(acq_date) AS last_day, count(*) AS days FROM c GROUP BY source, island, chunk""",
        "coverage_missing_days": f"{d} SELECT s.source, s.unit, CAST(g.x AS DATE) AS acq_date FROM (SELECT DISTINCT source, unit FROM d) AS s, generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) AS g(x) WHERE NOT EXISTS (FROM d WHERE d.unit = s.unit AND d.source = s.source AND d.acq_date = CAST(g.x AS DATE))",
        "space_time_pairs": f"WITH RECURSIVE {PAIRS_SQL} SELECT a, b FROM e",
        "event_components": f"WITH RECURSIVE {LABELS_SQL} SELECT id, event FROM l",
        "event_summary": f"""WITH RECURSIVE {LABELS_SQL} SELECT event, count(*) AS n, min(acq_ts) AS first_seen, max(acq_ts) AS last_seen, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north,
            array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM d JOIN l USING (id) GROUP BY event HAVING count(*) >= 3""",
        "event_span_bounded": f"WITH RECURSIVE {PIECES_SQL} SELECT id, event FROM n",
        "event_span_summary": f"""WITH RECURSIVE {PIECES_SQL}, g AS (SELECT n.event, count(*) AS n, min(acq_ts) AS first_seen, max(acq_ts) AS last_seen, min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north, avg(latitude) AS lat, avg(longitude) AS lon,
            array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(latitude) AS y0, max(latitude) AS y1, min(longitude) AS x0, max(longitude) AS x1 FROM d JOIN n USING (id) GROUP BY n.event HAVING count(*) >= 2)
            SELECT event, n, first_seen, last_seen, west, south, east, north, CAST(floor(lat * 1e6 + 37e-2) AS BIGINT) AS centroid_lat, CAST(floor(lon * 1e6 + 37e-2) AS BIGINT) AS centroid_lon, sources,
            CAST(floor({DIAGONAL_SQL} * 1e6 + 37e-2) AS BIGINT) AS span_km, {DIAGONAL_SQL} > {SPAN_KM} AS wide_span FROM g""",
        "overpass_passes": f"""{d}, s AS (SELECT *, coalesce(CAST(acq_ts - lag(acq_ts) OVER o > 1800 AS INT), 1) AS starts FROM d WINDOW o AS (PARTITION BY satellite ORDER BY acq_ts, id)),
            n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY satellite ORDER BY acq_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM s) SELECT satellite, number, min(acq_ts) AS first_ts, max(acq_ts) AS last_ts, count(*) AS n FROM n GROUP BY satellite, number""",
        "latest_positions": f"{d} SELECT unit, id, acq_ts, latitude, longitude FROM d QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts DESC, id DESC) = 1",
        "track_segments": f"""{d}, s AS (SELECT *, acq_ts - lag(acq_ts) {order} AS apart, lag(latitude) {order} AS lat, lag(longitude) {order} AS lon FROM d),
            t AS (SELECT *, CASE WHEN apart IS NULL OR apart > 36000 OR apart <= 0 OR {distance} / greatest(apart / 36e2, 1e-9) > 18e1 THEN 1 ELSE 0 END AS starts FROM s),
            n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY unit ORDER BY acq_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM t)
            SELECT unit, segment, count(*) AS n, min(acq_ts) AS first_ts, max(acq_ts) AS last_ts, min(id) AS first_id, CASE WHEN count(*) = 1 THEN 'Point' ELSE 'LineString' END AS kind FROM n GROUP BY unit, segment""",
        "position_interpolate": f"""{d}, p AS (SELECT * FROM d WHERE acq_ts <= {AT} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts DESC, id DESC) = 1),
            q AS (SELECT * FROM d WHERE acq_ts >= {AT} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts, id) = 1),
            j AS (SELECT unit, q.acq_ts - p.acq_ts AS gap, CASE WHEN q.acq_ts > p.acq_ts THEN ({AT} - p.acq_ts) / CAST(q.acq_ts - p.acq_ts AS DOUBLE) ELSE 0e0 END AS share, p.latitude AS a, q.latitude AS b, p.longitude AS c, q.longitude AS e FROM p JOIN q USING (unit))
            SELECT unit, gap, a + (b - a) * share AS latitude, c + (e - c) * share AS longitude FROM j WHERE gap <= 86400""",
        "clear_pass_anti_join": f"{d} SELECT g.t AS pass_ts FROM range(1704067200, 1706659200, 1800) AS g(t) WHERE NOT EXISTS (FROM d WHERE abs(g.t - acq_ts) <= 1800)",
        "circular_mean": f"{d}, m AS (SELECT unit, degrees(atan2(avg(sin(radians(CAST(id * 37 % 360 AS DOUBLE)))), avg(cos(radians(CAST(id * 37 % 360 AS DOUBLE)))))) AS a FROM d GROUP BY unit) SELECT unit, CAST(floor(((a + 360) % 36e1) * 100 + 37e-2) AS BIGINT) AS hundredths FROM m",
        "snapshot_diff": """WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 1)
            SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' WHEN s = o_orderstatus THEN 'identical' ELSE 'changed' END AS kind FROM l FULL JOIN r USING (o_orderkey)""",
        "industrial_persistence": f"""{d}, g AS (SELECT CAST(floor(latitude * 2) AS BIGINT) AS cell_y, CAST(floor(longitude * 2) AS BIGINT) AS cell_x, count(*) AS n, count(DISTINCT acq_date) AS days, CAST(max(acq_date) - min(acq_date) AS BIGINT) AS span,
            list_sort(list(frp)) AS f, count(*) FILTER (daynight = 'D') / CAST(nullif(count(*) FILTER (daynight = 'N'), 0) AS DOUBLE) AS day_night FROM d GROUP BY 1, 2)
            SELECT cell_y, cell_x, n, days, span, day_night, f[n // 2 + 1] AS frp_median, CASE WHEN n >= 4 THEN f[3 * n // 4 + 1] - f[n // 4 + 1] END AS frp_spread FROM g""",
        "telemetry_flags": f"{d}, o AS (SELECT id, unit, acq_ts - (id % 13) * 3000 AS observed FROM d) SELECT id, unit, coalesce(observed < max(observed) OVER (PARTITION BY unit ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM o",
    }
