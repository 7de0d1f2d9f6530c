"""Queries of the incident workspace, of gridded surfaces and of scalar functions over the driver's tables, with their DuckDB SQL.

The driver's tables have no alerts, features or telemetry, so these are views of orders, customers, suppliers and events:
a view's columns are arithmetic on keys, and both engines read every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import geo, text
from emberframe.operators import events as fires
from emberframe.operators import incidents, positions, surfaces
from emberframe.operators import workspace as desk
from emberframe.plans.incidents import _units, areas, sources, units
from emberframe.session import table
from emberframe.sources.detections import DETECTIONS_SQL, detections

NOW, DAY = 820_454_400, 86_400  #: 1996-01-01
AT, WINDOW = 1_705_000_000, 72 * 3600
EVENT = "unit * 100 + acq_ts // 259200 % 100"
BOX = (10.0, 36.0, 13.0, 41.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D = f"WITH RECURSIVE {DETECTIONS_SQL}"


def query(sql: str) -> Callable:
    """Registers a query with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").cast("long").alias("cust"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


O = "o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS cust, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select((F.col("unit") * 100 + F.floor(F.col("acq_ts") / 259_200) % 100).alias("event"), F.col("id").alias("detection_id"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.summaries(detections(spark, sf_dir), members(spark, sf_dir).select(F.col("detection_id").alias("id"), "event"))


SUMMARY = f"{D}, s AS (SELECT {EVENT} AS event, count(*) AS n, min(acq_ts) AS first_seen, max(acq_ts) AS last_seen, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north FROM d GROUP BY 1)"


@query(f"{D} SELECT {EVENT} AS event, id, acq_ts, instrument, confidence_level, frp, scan, track FROM d")
def event_member_join(spark, sf_dir):
    seen = detections(spark, sf_dir)
    return members(spark, sf_dir).join(seen, F.col("detection_id") == F.col("id")).select("event", "id", "acq_ts", "instrument", "confidence_level", "frp", "scan", "track")


@query(f"{SUMMARY} SELECT event, n, last_seen FROM s WHERE west <= {BOX[2]} AND east >= {BOX[0]} AND south <= {BOX[3]} AND north >= {BOX[1]} ORDER BY last_seen DESC, event DESC LIMIT 100")
def event_bbox_overlap(spark, sf_dir):
    return desk.newest(summaries(spark, sf_dir).where(desk.overlaps(*BOX)), "last_seen", 100, "event").select("event", "n", "last_seen")


@query(f"{SUMMARY} SELECT event, last_seen FROM s WHERE 1002e-2 BETWEEN west AND east AND 3602e-2 BETWEEN south AND north ORDER BY last_seen DESC, event DESC LIMIT 5")
def event_at_point(spark, sf_dir):
    found = summaries(spark, sf_dir).where(F.lit(10.02).between(F.col("west"), F.col("east")) & F.lit(36.02).between(F.col("south"), F.col("north")))
    return desk.newest(found, "last_seen", 5, "event").select("event", "last_seen")


@query(f"{D} SELECT id, acq_ts, latitude, longitude FROM d ORDER BY acq_ts DESC, id DESC LIMIT 40000")
def clustering_input(spark, sf_dir):
    return desk.newest(detections(spark, sf_dir), "acq_ts", 40_000, ascending=True).select("id", "acq_ts", "latitude", "longitude")


@query("""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS source_id, 3601e-2 + CAST(s_suppkey % 12 AS DOUBLE) * 75e-2 AS lat, 1002e-2 + CAST(s_suppkey % 13 AS DOUBLE) * 9e-1 AS lon FROM supplier), c AS (SELECT CAST(c_custkey AS BIGINT) AS source_id, c_mktsegment AS class FROM customer WHERE c_custkey % 3 = 0)
    SELECT source_id, class FROM s LEFT JOIN c USING (source_id) WHERE lat BETWEEN 37 AND 41 AND lon BETWEEN 12 AND 19""")
def industrial_left_join(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("source_id"), F.col("c_mktsegment").alias("class"))
    return sources(spark, sf_dir).where(geo.in_bbox(F.col("lat"), F.col("lon"), 12.0, 37.0, 19.0, 41.0)).join(scores, "source_id", "left").select("source_id", "class")


def alerts(spark, sf_dir):
    i, west = F.col("id"), F.when(F.col("id") % 11 != 0, 10 + (F.col("id") % 9).cast("double"))
    south = F.when(i % 11 != 0, 36 + (i % 8).cast("double"))
    return orders(spark, sf_dir).select("id", (F.col("day") * DAY).alias("sent"), F.when(i % 7 != 0, (F.col("day") + i % 900) * DAY).alias("expires"), F.concat(F.lit("s"), i % 5).alias("severity"), (i % 5).alias("severity_rank"), west.alias("west"), south.alias("south"), (west + 1).alias("east"), (south + 1).alias("north"))


@query(f"""WITH {O}, a AS (SELECT id, day * {DAY} AS sent, CASE WHEN id % 7 <> 0 THEN (day + id % 900) * {DAY} END AS expires, id % 5 AS severity_rank, CASE WHEN id % 11 <> 0 THEN 10 + CAST(id % 9 AS DOUBLE) END AS w, CASE WHEN id % 11 <> 0 THEN 36 + CAST(id % 8 AS DOUBLE) END AS s FROM o)
    SELECT id, severity_rank, sent FROM a WHERE (expires IS NULL OR expires >= {NOW}) AND w <= {BOX[2]} AND w + 1 >= {BOX[0]} AND s <= {BOX[3]} AND s + 1 >= {BOX[1]}""")
def alerts_in_force(spark, sf_dir):
    return desk.alerts_in_force(alerts(spark, sf_dir), NOW, BOX).select("id", "severity_rank", "sent")


@query(f"WITH {O} SELECT cust AS identifier, min(day) AS received_at, max(day) AS updated_at, arg_max(priority, day * 100000000 + id) AS content FROM o GROUP BY cust")
def alert_upsert(spark, sf_dir):
    return desk.alert_upsert(orders(spark, sf_dir).select("id", F.col("cust").alias("identifier"), F.col("day").alias("received"), F.col("priority").alias("content")))


@query(f"WITH {O} SELECT id FROM o WHERE id % 9 = 0 OR day * {DAY} >= {NOW} - 400 * {DAY} ORDER BY day DESC, id DESC LIMIT 5000")
def alerts_prune(spark, sf_dir):
    return desk.newest(orders(spark, sf_dir).where((F.col("id") % 9 == 0) | (F.col("day") * DAY >= NOW - 400 * DAY)), "day", 5000).select("id")


@query(f"{D} SELECT unit, id FROM d QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts DESC, id DESC) <= 50")
def webhook_keep_newest(spark, sf_dir):
    return desk.newest_of_each(detections(spark, sf_dir), ["unit"], "acq_ts", 50).select("unit", "id")


@query(f"WITH {O} SELECT id, day AS updated FROM o WHERE cust % 25 = 3 AND id % 3 = 1 AND id % 13 <> 0")
def feature_list(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("deleted_at", F.when(F.col("id") % 13 == 0, F.col("day")))
    return o.where((F.col("cust") % 25 == 3) & (F.col("id") % 3 == 1) & F.col("deleted_at").isNull()).orderBy(F.desc("day")).select("id", F.col("day").alias("updated"))


@query(f"WITH {O}, t AS (SELECT id, coalesce(CASE WHEN id % 4 <> 0 THEN day END, CASE WHEN id % 8 <> 0 THEN day + 9 END, -4611686018427387904) AS t FROM o) SELECT id, t <= 9000 AS before, t <= 9400 AS after, t > 9000 AND t <= 9400 AS new FROM t")
def feature_progression(spark, sf_dir):
    i, day = F.col("id"), F.col("day")
    return desk.progression(orders(spark, sf_dir).select("id", F.when(i % 4 != 0, day).alias("observed"), F.when(i % 8 != 0, day + 9).alias("created")), 9000, 9400)


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS changed_at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(CAST(o_orderdate AS DATE) AS VARCHAR) > '1995-06-01' ORDER BY changed_at DESC, id DESC LIMIT 1000")
def audit_recent(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("entity_type"), F.col("o_orderdate").cast("date").cast("string").alias("changed_at"))
    return desk.audit_recent(log, ["1-URGENT", "2-HIGH"], "1995-06-01", 5000).select("id", "changed_at")


@query(f"WITH {O} SELECT id, cust AS incident FROM o WHERE status <> 'F' AND priority = '5-LOW'")
def link_list(spark, sf_dir):
    return orders(spark, sf_dir).where((F.col("status") != "F") & (F.col("priority") == "5-LOW")).orderBy(F.desc("day"), "id").select("id", F.col("cust").alias("incident"))


@query(f"WITH {O}, j AS (SELECT id, CASE WHEN status = 'F' THEN day END AS finished FROM o) SELECT id FROM j WHERE NOT (finished IS NOT NULL AND finished < 9300 AND id NOT IN (SELECT id FROM j ORDER BY id DESC LIMIT 200))")
def jobs_purge(spark, sf_dir):
    return desk.purge_jobs(orders(spark, sf_dir).select("id", F.when(F.col("status") == "F", F.col("day")).alias("finished")), 9300).select("id")


@query(f"""{D}, c AS (SELECT source, CAST(floor((longitude + 180) / 10) AS BIGINT) AS cell_x, CAST(floor((latitude + 90) / 10) AS BIGINT) AS cell_y, acq_date, id, id % 7 <> 0 AS ok FROM d)
    SELECT source, cell_x, cell_y, acq_date, max(id) AS last_id, arg_max(ok, id) AS ok FROM c GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY source, cell_x, cell_y, acq_date"))
def coverage_state(spark, sf_dir):
    x, y = geo.grid_cell(F.col("latitude"), F.col("longitude"), 10.0)
    marks = detections(spark, sf_dir).select("source", x.alias("cell_x"), y.alias("cell_y"), "acq_date", F.col("id").alias("last_id"), (F.col("id") % 7 != 0).alias("ok"))
    return desk.latest_wins(marks, ["source", "cell_x", "cell_y", "acq_date"], ["last_id"])


@query(f"""{D}, c AS (SELECT DISTINCT satellite, CAST(floor((longitude + 180) / 5e-1) AS BIGINT) AS x, CAST(floor((latitude + 90) / 5e-1) AS BIGINT) AS y FROM d) SELECT satellite, x, y FROM c WHERE x BETWEEN 380 AND 385 AND y BETWEEN 252 AND 261""")
def swath_cells_in_bbox(spark, sf_dir):
    x, y = geo.grid_cell(F.col("latitude"), F.col("longitude"), 0.5)
    low, high = geo.grid_cell(F.lit(BOX[1]), F.lit(BOX[0]), 0.5), geo.grid_cell(F.lit(BOX[3] - 1e-9), F.lit(BOX[2] - 1e-9), 0.5)
    cells = detections(spark, sf_dir).select("satellite", x.alias("x"), y.alias("y")).distinct()
    return cells.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))


@query(f"{D} SELECT 'detections' AS name, count(*) AS n, max(acq_ts) AS newest FROM d UNION ALL SELECT 'days', count(DISTINCT acq_date), max(acq_ts) FROM d UNION ALL SELECT 'cells', count(DISTINCT (floor(longitude * 2), floor(latitude * 2))), max(acq_ts) FROM d")
def table_sizes(spark, sf_dir):
    d = detections(spark, sf_dir)
    wide = d.agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("acq_date").alias("days"), F.countDistinct(F.floor(F.col("longitude") * 2), F.floor(F.col("latitude") * 2)).alias("cells"), F.max("acq_ts").alias("newest"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n"), "newest") for c in ("detections", "days", "cells")])).alias("r")).select("r.*")


@query(f"{D} SELECT satellite, acq_date, max(acq_ts) AS computed_at, count(DISTINCT CAST(floor(longitude) AS BIGINT)) AS columns FROM d GROUP BY satellite, acq_date")
def swath_computed_at(spark, sf_dir):
    return detections(spark, sf_dir).groupBy("satellite", "acq_date").agg(F.max("acq_ts").alias("computed_at"), F.countDistinct(F.floor("longitude").cast("long")).alias("columns"))


def reports(spark, sf_dir):
    i = F.col("id")
    return detections(spark, sf_dir).select(
        "id", F.floor(i / 50).alias("batch"), F.when(i % 17 != 0, F.concat(F.lit("r"), i % 45)).alias("external_id"), F.when(i % 19 != 0, F.concat(F.lit("u"), "unit")).otherwise("  ").alias("callsign"), (F.col("acq_ts") + F.when(i % 23 == 0, 900).otherwise(0)).alias("observed"), F.col("acq_ts").alias("received"),
        (F.col("latitude") + F.when(i % 29 == 0, 60).otherwise(0)).alias("latitude"), "longitude", F.when(i % 5 != 0, (i % 31 - 1).cast("double")).alias("speed"), (i % 37 - 1).cast("double").alias("accuracy"), (i % 363).cast("double").alias("heading"), "unit",
    )


REPORTS = f"""{D}, r AS (SELECT id, id // 50 AS batch, CASE WHEN id % 17 <> 0 THEN 'r' || (id % 45) END AS external_id, CASE WHEN id % 19 <> 0 THEN 'u' || unit ELSE '  ' END AS callsign, acq_ts + CASE WHEN id % 23 = 0 THEN 900 ELSE 0 END AS observed, acq_ts AS received, latitude + CASE WHEN id % 29 = 0 THEN 60 ELSE 0 END AS latitude, longitude,
    CASE WHEN id % 5 <> 0 THEN CAST(id % 31 - 1 AS DOUBLE) END AS speed, CAST(id % 37 - 1 AS DOUBLE) AS accuracy, CAST(id % 363 AS DOUBLE) AS heading, unit FROM d)"""


@query(f"""{REPORTS}, o AS (SELECT *, trim(coalesce(external_id, '')) = '' OR trim(callsign) = '' AS bad, CASE WHEN observed > received + 300 THEN 'future' WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude' WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude' WHEN speed < 0 THEN 'speed' WHEN accuracy < 0 THEN 'accuracy' WHEN heading NOT BETWEEN 0 AND 360 THEN 'heading' END AS own FROM r)
    SELECT id, CASE WHEN bad THEN 'missing_external_id_or_callsign' WHEN EXISTS (FROM o AS e WHERE e.batch = o.batch AND e.external_id = o.external_id AND e.id < o.id AND NOT e.bad AND e.own IS NULL) THEN 'duplicate_in_batch' ELSE own END AS reason FROM o""")
def telemetry_rejects(spark, sf_dir):
    return desk.telemetry_rejects(reports(spark, sf_dir))


@query("""WITH RECURSIVE z AS (SELECT unnest(range(3, 9)) AS z), b AS (SELECT z, CAST(floor((10 + 180) / 36e1 * pow(2, z)) AS BIGINT) AS x0, CAST(ceil((13 + 180) / 36e1 * pow(2, z)) AS BIGINT) - 1 AS x1, CAST(floor((1 - ln(tan(radians(41e0)) + 1 / cos(radians(41e0))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y0, CAST(ceil((1 - ln(tan(radians(36e0)) + 1 / cos(radians(36e0))) / pi()) / 2 * pow(2, z)) AS BIGINT) - 1 AS y1 FROM z),
    x AS (SELECT z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM b) SELECT CAST(z AS BIGINT) AS z, x, unnest(range(y0, y1 + 1)) AS y FROM x""")
def expected_tiles(spark, sf_dir):
    return geo_tiles(spark, BOX, 3, 8)


def geo_tiles(spark: SparkSession, box: tuple[float, float, float, float], low: int, high: int) -> DataFrame:
    """(z, x, y) of all tiles that cover a box, its east and south edge excluded."""
    side = F.pow(F.lit(2.0), F.col("z"))
    across = lambda lon: (F.lit(lon) + 180) / 360.0 * side
    down = lambda lat: (1 - F.log(F.tan(F.radians(F.lit(lat))) + 1 / F.cos(F.radians(F.lit(lat)))) / F.pi()) / 2 * side
    west, south, east, north = box
    zooms = spark.range(low, high + 1).withColumnRenamed("id", "z")
    return zooms.withColumn("x", F.explode(F.sequence(F.floor(across(west)), F.ceil(across(east)) - 1))).select("z", "x", F.explode(F.sequence(F.floor(down(north)), F.ceil(down(south)) - 1)).alias("y"))


@query(f"WITH {O} SELECT o.id, o.day FROM o JOIN customer ON o.cust = c_custkey WHERE c_mktsegment = 'BUILDING' AND o.id % 4 = 0")
def public_products(spark, sf_dir):
    incident = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("cust"))
    return orders(spark, sf_dir).where("id % 4 = 0").join(incident, "cust").orderBy(F.desc("day")).select("id", "day")


_CHECKS = "('hazards', 0), ('lookouts', 1), ('communications', 2), ('escape_routes', 3), ('safety_zones', 4), ('medical', 5), ('alternative_access', 6), ('withdrawal_triggers', 7), ('weather_update', 8)"


@query(f"WITH {O}, c AS (SELECT * FROM (VALUES {_CHECKS}) AS c(item, i)) SELECT p.id AS period_id, c.item, (p.id * 7 + c.i) % 5 < 2 AND (p.id + c.i) % 3 <> 0 AS checked FROM o AS p, c")
def safety_checklist(spark, sf_dir):
    periods = orders(spark, sf_dir).select(F.col("id").alias("period_id"))
    stored = periods.select("period_id", F.posexplode(F.array(*[F.lit(c) for c in desk.CHECKS])).alias("i", "item")).where("(period_id + i) % 3 <> 0").select("period_id", "item", ((F.col("period_id") * 7 + F.col("i")) % 5 < 2).alias("checked"))
    return desk.checklist(periods, stored)


@query(f"{D} SELECT id FROM d WHERE NOT (unit % 5 = 1 AND unit % 4 <> 0 AND acq_ts < {AT})")
def position_retention(spark, sf_dir):
    seen = detections(spark, sf_dir)
    closed = seen.where("unit % 5 = 1 AND unit % 4 <> 0").select("unit").distinct()
    return seen.join(closed.withColumn("closed", F.lit(True)), "unit", "left").where(F.col("closed").isNull() | (F.col("acq_ts") >= AT)).select("id")


def _inside() -> str:
    corner = [("x - 2e-2", "y - 2e-2"), ("x + 8e-2", "y + 1e-3"), ("x + 2e-3", "y + 6e-2")]
    edges = [(corner[i], corner[(i + 1) % 3]) for i in range(3)]
    return " + ".join(f"CAST((({p[1]}) > latitude) <> (({q[1]}) > latitude) AND longitude < (({q[0]}) - ({p[0]})) * (latitude - ({p[1]})) / nullif(({q[1]}) - ({p[1]}), 0) + ({p[0]}) AS INT)" for p, q in edges)


@query(f"""{D}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, 10e0 + CAST(n_nationkey % 13 AS DOUBLE) * 9e-1 AS x, 36e0 + CAST(n_nationkey % 12 AS DOUBLE) * 75e-2 AS y FROM nation), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts DESC, id DESC) = 1)
    SELECT unit, zone FROM l, n WHERE ({_inside()}) % 2 = 1""")
def geofence(spark, sf_dir):
    return incidents.covering(positions.latest(detections(spark, sf_dir)), areas(spark, sf_dir)).select("unit", F.col("incident_id").alias("zone"))


@query(f"WITH {O} SELECT cust AS incident, max(day) AS reference, arg_max(id, day * 100000000 + id) AS run, arg_max(priority, day * 100000000 + id) AS job FROM o WHERE status <> 'P' AND day <= 9400 GROUP BY cust")
def active_model_run(spark, sf_dir):
    runs = orders(spark, sf_dir).where((F.col("status") != "P") & (F.col("day") <= 9400)).select(F.col("cust").alias("incident"), F.col("day").alias("reference"), F.col("id").alias("run"), F.col("priority").alias("job"))
    return desk.latest_wins(runs, ["incident"], ["reference", "run"])


_KM = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(36e0 - latitude) / 2), 2e0) + cos(radians(latitude)) * cos(radians(36e0)) * pow(sin(radians(10e0 - longitude) / 2), 2e0))))"


@query(f"""{D}, k AS (SELECT id, acq_ts, {_KM} AS km FROM d), l AS (SELECT unit, {_KM} AS km FROM d QUALIFY row_number() OVER (PARTITION BY unit ORDER BY acq_ts DESC, id DESC) = 1)
    SELECT 'detections' AS section, count(*) AS n, arg_min(id, km * 1e9 + id) AS nearest FROM k WHERE km <= 40 UNION ALL SELECT 'units', count(*), arg_min(unit, km * 1e9 + unit) FROM (SELECT * FROM l ORDER BY km, unit LIMIT 5) UNION ALL
    SELECT 'events', count(*), max(event) FROM (SELECT {EVENT} AS event, min(longitude) AS w, min(latitude) AS s FROM d GROUP BY 1 HAVING w <= 10 AND max(longitude) >= 10 AND s <= 36 AND max(latitude) >= 36)""")
def situation_point(spark, sf_dir):
    """What is around a point: one row per provider."""
    d = detections(spark, sf_dir)
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(36.0), F.lit(10.0))
    section = lambda name, frame, nearest: frame.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"), nearest.alias("nearest"))
    close = d.withColumn("km", km).where(F.col("km") <= 40)
    units_ = positions.latest(d).withColumn("km", km).orderBy("km", "unit").limit(5)
    here = summaries(spark, sf_dir).where(desk.overlaps(10.0, 36.0, 10.0, 36.0))
    return section("detections", close, F.min_by("id", F.struct("km", "id"))).union(section("units", units_, F.min_by("unit", F.struct("km", "unit")))).union(section("events", here, F.max("event")))


@query(f"WITH {O} SELECT day AS period_id, cust AS resource_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(id))), ',') AS features, substr(sha256(concat_ws('|', day, cust, array_to_string(list_sort(list_distinct(list(id))), ','))), 1, 24) AS warning_id FROM o GROUP BY day, cust HAVING count(*) > 1")
def tactical_double_assignment(spark, sf_dir):
    return desk.double_assignments(orders(spark, sf_dir).select(F.col("day").alias("period_id"), F.col("cust").alias("resource_id"), F.col("id").alias("feature_id")))


@query(f"WITH {O} SELECT o.id, o.cust * 2 AS missing FROM o WHERE NOT EXISTS (FROM customer WHERE c_custkey = o.cust * 2)")
def tactical_unknown_resources(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("missing"))
    return orders(spark, sf_dir).select("id", (F.col("cust") * 2).alias("missing")).join(known, "missing", "left_anti").select("id", "missing")


@query("""WITH a AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey % 40 AS x1, s_suppkey % 23 AS y1, s_suppkey % 40 + s_suppkey % 5 AS x2, s_suppkey % 23 + s_suppkey % 3 AS y2 FROM supplier), b AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey AS x1, 0 AS y1, n_nationkey + 9 AS x2, 21 AS y2 FROM nation)
    SELECT a.id AS a_id, b.id AS b_id FROM a, b WHERE greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)
    AND ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0 AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0""")
def route_crossings(spark, sf_dir):
    k, n = F.col("s_suppkey").cast("long"), F.col("n_nationkey").cast("long")
    a = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 40).alias("x1"), (k % 23).alias("y1"), (k % 40 + k % 5).alias("x2"), (k % 23 + k % 3).alias("y2"))
    b = table(spark, sf_dir, "nation").select(n.alias("id"), n.alias("x1"), F.lit(0).cast("long").alias("y1"), (n + 9).alias("x2"), F.lit(21).cast("long").alias("y2"))
    return desk.crossings(a, b, 4.0)


@query("SELECT CAST(event_id AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS feature FROM events JOIN customer ON CAST(json_extract_string(props, '$.k') AS BIGINT) = c_custkey")
def cot_lookup(spark, sf_dir):
    uid = F.get_json_object("props", "$.k").cast("long")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("feature"))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), uid.alias("feature")).join(known, "feature").select("id", "feature")


@query("SELECT coalesce(o_orderstatus, 'all') AS layer, coalesce(o_orderpriority, 'all') AS zoom, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS pinned FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def completeness_breakdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("pinned"))
    return o.select(F.coalesce("o_orderstatus", F.lit("all")).alias("layer"), F.coalesce("o_orderpriority", F.lit("all")).alias("zoom"), "n", "pinned")


@query(f"WITH {O} SELECT cust, id, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 ELSE 2 END AS rank FROM o QUALIFY row_number() OVER (PARTITION BY cust ORDER BY CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 ELSE 2 END, day DESC, id) = 1")
def scenario_first(spark, sf_dir):
    """Each incident's scenario that a list shows first: primary, then contingency, then others, newest first."""
    i = F.col("id")
    ranked = orders(spark, sf_dir).select("cust", "id", F.when(i % 3 == 0, 0).when(i % 3 == 1, 1).otherwise(2).alias("rank"), "day")
    return ranked.groupBy("cust").agg(F.min_by(F.struct("id", "rank"), F.struct("rank", -F.col("day"), "id")).alias("r")).select("cust", "r.*")


@query(f"WITH {O} SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 3 = id % 4 THEN 'applied' ELSE 'conflict' END AS outcome, CASE WHEN id % 11 <> 0 THEN id % 3 + CASE WHEN id % 3 = id % 4 THEN 1 ELSE 0 END END AS revision, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = id % 4 THEN 'new' ELSE status END AS content FROM o")
def revision_updates(spark, sf_dir):
    o = orders(spark, sf_dir)
    current = o.where("id % 11 <> 0").select("id", F.col("status").alias("content"), (F.col("id") % 3).alias("revision"))
    return desk.revise(current, o.select("id", (F.col("id") % 4).alias("expected"), F.lit("new").alias("content")))


@query(f"WITH {O} SELECT id, CASE WHEN id % 6 = 0 AND id % 10 <> 0 THEN 'inactive' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN day WHEN id % 6 = 0 THEN 9999 END AS deleted_at, 1 + CASE WHEN id % 6 = 0 AND id % 10 <> 0 THEN 1 ELSE 0 END AS revision FROM o")
def feature_soft_delete(spark, sf_dir):
    o = orders(spark, sf_dir).select("id", "status", F.when(F.col("id") % 10 == 0, F.col("day")).alias("deleted_at"), F.lit(1).cast("long").alias("revision"))
    return desk.soft_delete(o, o.where("id % 6 = 0"), 9999).withColumn("revision", F.col("revision").cast("int"))


@query(f"WITH {O} SELECT id, CASE WHEN id % 5 = 0 OR (id % 7 <> 0 AND id % 3 = 0) THEN 'theirs' ELSE status END AS content, CASE WHEN id % 5 = 0 OR (id % 7 <> 0 AND id % 3 = 0) THEN 'incoming' ELSE 'local' END AS taken FROM o WHERE id % 5 <> 0 OR id % 7 <> 0")
def merge_choices(spark, sf_dir):
    o = orders(spark, sf_dir)
    return desk.merge(o.where("id % 5 <> 0").select("id", F.col("status").alias("content")), o.where("id % 7 <> 0").select("id", F.lit("theirs").alias("content")), o.where("id % 2 = 0 OR id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, "incoming").otherwise("local").alias("side")))


@query(f"WITH {O} SELECT sha256(priority || cust) AS hash, min(id) AS id FROM o WHERE priority || cust NOT IN (SELECT priority || cust FROM o WHERE id % 50 = 0) GROUP BY 1")
def merge_staging(spark, sf_dir):
    o = orders(spark, sf_dir).select("id", F.concat("priority", F.col("cust").cast("string")).alias("content"))
    return desk.staged(o, o.where("id % 50 = 0"))


@query(f"WITH {O} SELECT id AS link_id, CASE WHEN cust % 3 = 0 THEN cust + 1000000 ELSE cust END AS source, CASE WHEN (id % 900) % 3 = 0 AND id % 900 IN (SELECT c_custkey FROM customer) THEN id % 900 + 1000000 ELSE id % 900 END AS target FROM o")
def scenario_copy_links(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("old"), (F.col("c_custkey") + 1_000_000).cast("long").alias("new"))
    return desk.copied(orders(spark, sf_dir).select(F.col("id").alias("link_id"), F.col("cust").alias("source"), (F.col("id") % 900).alias("target")), ids)


@query(f"""{D}, c AS (SELECT CAST(floor(latitude * 4) AS BIGINT) AS g, CAST(floor(longitude * 50) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY 1, 2), r AS (SELECT g, value, sum(value) OVER w AS upto, sum(value) OVER (PARTITION BY g) AS whole, count(*) OVER w AS cells FROM c WINDOW w AS (PARTITION BY g ORDER BY value DESC RANGE UNBOUNDED PRECEDING))
    SELECT g, s.share, max(value) AS level, min(cells) AS cells FROM r, (VALUES (5e-1), (8e-1), (95e-2)) AS s(share) WHERE upto >= s.share * whole GROUP BY g, s.share""")
def probability_mass_levels(spark, sf_dir):
    cells = detections(spark, sf_dir).groupBy(F.floor(F.col("latitude") * 4).cast("long").alias("g"), F.floor(F.col("longitude") * 50).cast("long").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return surfaces.mass_levels(cells, "g", (0.5, 0.8, 0.95))


@query(f"""{D}, p AS (SELECT satellite, acq_ts // 1800 AS number, max(acq_ts) AS last_ts FROM d GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY satellite ORDER BY last_ts, number) - 1 AS place, count(*) OVER (PARTITION BY satellite) AS n FROM p),
    c AS (SELECT DISTINCT satellite, CAST(CASE WHEN least(n, 10) = 1 THEN 0 ELSE round_even(s.i * (n - 1) / CAST(least(n, 10) - 1 AS DOUBLE), 0) END AS BIGINT) AS place FROM q, range(10) AS s(i) WHERE s.i < least(n, 10)), b AS (SELECT *, row_number() OVER (PARTITION BY satellite ORDER BY place) - 1 AS band, count(*) OVER (PARTITION BY satellite) AS bands FROM c)
    SELECT b.satellite, band, last_ts AS cutoff_ts, band / CAST(greatest(1, bands - 1) AS DOUBLE) AS fraction FROM b JOIN q USING (satellite, place)""")
def spread_bands(spark, sf_dir):
    passes = detections(spark, sf_dir).groupBy("satellite", F.floor(F.col("acq_ts") / 1800).alias("number")).agg(F.max("acq_ts").alias("last_ts"))
    return surfaces.spread_bands(passes, "satellite").withColumn("band", F.col("band").cast("long"))


_NEAR = f"""{D}, n AS (SELECT *, greatest(15e-2, sqrt(scan * scan + track * track) / 2) AS sigma FROM (SELECT d.* REPLACE (CASE WHEN id % 50 = 0 THEN 2e0 ELSE scan END AS scan, CASE WHEN id % 50 = 0 THEN 48e-1 ELSE track END AS track, CASE WHEN id % 2 = 0 THEN latitude + 28 ELSE latitude END AS latitude) FROM d)),
    c AS (SELECT n.*, i.i AS row, j.j AS col FROM n, range(CAST(floor((latitude - {{0}} / 110574e-3) / {{1}}) AS BIGINT) - 1, CAST(floor((latitude + {{0}} / 110574e-3) / {{1}}) AS BIGINT) + 2) AS i(i), range(CAST(floor((longitude - {{0}} / 30e0) / {{1}}) AS BIGINT) - 1, CAST(floor((longitude + {{0}} / 30e0) / {{1}}) AS BIGINT) + 2) AS j(j)),
    k AS (SELECT *, sqrt(pow((longitude - (col + 5e-1) * {{1}}) * 11132e-2 * cos(radians(latitude)), 2) + pow((latitude - (row + 5e-1) * {{1}}) * 110574e-3, 2)) AS km FROM c)"""


def spread_seen(spark, sf_dir):
    """Detections half of which lie at 64 degrees north or farther, every fiftieth with the pixel of a scan's edge."""
    i = F.col("id")
    return detections(spark, sf_dir).withColumns({"scan": F.when(i % 50 == 0, 2.0).otherwise(F.col("scan")), "track": F.when(i % 50 == 0, 4.8).otherwise(F.col("track")), "latitude": F.when(i % 2 == 0, F.col("latitude") + 28).otherwise(F.col("latitude"))})


@query(f"""{_NEAR.format("5 * sigma", "1e-2")}, w AS (SELECT row, col, least(999e-3, CASE instrument WHEN 'VIIRS' THEN 1e0 ELSE 7e-1 END * CASE confidence_level WHEN 'high' THEN 1e0 WHEN 'nominal' THEN 7e-1 WHEN 'low' THEN 35e-2 ELSE 5e-1 END * exp(-pow(km / sigma, 2) / 2) * exp(-greatest(0e0, (1706745600 - acq_ts) / 36e2) / 24e1) * (1 + least(15e-1, ln(1 + greatest(0e0, coalesce(frp, 0))) / 6))) AS p FROM k WHERE km <= 5 * sigma)
    SELECT row, col, {_units('(1 - exp(sum(ln(1 - p))))', '1e6')} AS heat_e6 FROM w GROUP BY row, col""")
def heat_grid(spark, sf_dir):
    return surfaces.heat(spread_seen(spark, sf_dir), 1e-2, 1_706_745_600, 240.0).select("row", "col", units(F.col("heat"), 1e6).alias("heat_e6"))


@query(f"""{_NEAR.format("2e0", "1e-2")}, w AS (SELECT row, col, acq_ts, 1 / (km * km * 1e6 + 1e-6) AS w FROM k WHERE km <= 2), m AS (SELECT row, col, sum(w * acq_ts) / sum(w) AS mean, count(*) AS n FROM w GROUP BY row, col),
    a AS (SELECT row, col, any_value(n) AS n, any_value(mean) AS mean, sqrt(sum(w * pow(acq_ts - mean, 2)) / sum(w)) AS deviation FROM w JOIN m USING (row, col) GROUP BY row, col)
    SELECT row, col, n, {_units('mean', '1e-1')} AS median_ds, {_units('(mean - deviation)', '1e-1')} AS earliest_ds, {_units('(mean + deviation)', '1e-1')} AS latest_ds FROM a""")
def arrival_grid(spark, sf_dir):
    found = surfaces.arrival(spread_seen(spark, sf_dir), 1e-2, 2.0, 1_706_745_600)
    return found.select("row", "col", "n", *[units(F.col(c), 0.1).alias(f"{c}_ds") for c in ("median", "earliest", "latest")])


def winds(spark, sf_dir):
    i = F.col("id")
    return detections(spark, sf_dir).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("acq_ts").alias("observed"), (i % 25 / 2.0).alias("speed"), (i * 37 % 360).cast("double").alias("from_deg"))


_WIND_KM = "2 * 63710088e-4 * asin(least(1e0, sqrt(pow(sin(radians(o.latitude - p.lat) / 2), 2e0) + cos(radians(p.lat)) * cos(radians(o.latitude)) * pow(sin(radians(o.longitude - p.lon) / 2), 2e0))))"


@query(f"""{D}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, 3601e-2 + CAST(s_suppkey % 12 AS DOUBLE) * 75e-2 AS lat, 1002e-2 + CAST(s_suppkey % 13 AS DOUBLE) * 9e-1 AS lon FROM supplier), k AS (SELECT point_id, {_WIND_KM} AS km, acq_ts, -(id % 25 / 2e0) * sin(radians(id * 37 % 360)) AS u, -(id % 25 / 2e0) * cos(radians(id * 37 % 360)) AS v FROM p, d AS o WHERE acq_ts > {AT - WINDOW} AND acq_ts <= {AT}),
    w AS (SELECT *, pow(5e-1, ({AT} - acq_ts) / {WINDOW / 2}) / (km * km + 1e-2) AS w FROM k WHERE km <= 60), a AS (SELECT point_id, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v, sum(w * (u * u + v * v)) / sum(w) AS s, count(*) AS n, min(km) AS km FROM w GROUP BY point_id)
    SELECT point_id, n, {_units('u', '1e6')} AS u_e6, {_units('v', '1e6')} AS v_e6, {_units('km', '1e6')} AS nearest_mm, {_units('sqrt(greatest(0e0, s - u * u - v * v))', '1e4')} AS disagreement_e4 FROM a""")
def wind_field(spark, sf_dir):
    found = surfaces.wind_field(sources(spark, sf_dir).withColumnRenamed("source_id", "point_id"), winds(spark, sf_dir), AT, WINDOW, 60.0)
    return found.select("point_id", "n", units(F.col("u"), 1e6).alias("u_e6"), units(F.col("v"), 1e6).alias("v_e6"), units(F.col("nearest_km"), 1e6).alias("nearest_mm"), units(F.col("disagreement"), 1e4).alias("disagreement_e4"))


_RUN_TEXTS = ("4 m/s", "18 km/h", "9kt", "fresh")


@query(f"""WITH {O}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, 3601e-2 + CAST(s_suppkey % 12 AS DOUBLE) * 75e-2 AS lat, 1002e-2 + CAST(s_suppkey % 13 AS DOUBLE) * 9e-1 AS lon FROM supplier),
    r AS (SELECT id, cust % 100 + 1 AS point_id, {AT} + (id % 41 - 30) * 3600 AS reference, [4e0, 18 / 36e-1, 9 * 514444e-6, NULL][id % 4 + 1] AS speed, CASE WHEN id % 11 <> 0 THEN CAST(id * 13 % 360 AS DOUBLE) END AS way, {AT} + (id % 5 - 2) * 7200 AS until FROM o)
    SELECT point_id, id AS run_id, reference, {_units('(-speed * sin(radians(way)))', '1e6')} AS u_e6, {_units('(-speed * cos(radians(way)))', '1e6')} AS v_e6, until < {AT} AS stale FROM r WHERE reference <= {AT} AND speed IS NOT NULL AND way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY reference DESC, id DESC) = 1""")
def wind_background(spark, sf_dir):
    found = surfaces.background(wind_runs(spark, sf_dir), "point_id", AT)
    return found.select("point_id", "run_id", "reference", units(F.col("u"), 1e6).alias("u_e6"), units(F.col("v"), 1e6).alias("v_e6"), "stale")


def wind_runs(spark, sf_dir):
    """Model runs with winds as text, some of which can't be read."""
    i = F.col("id")
    speed = text.speed(F.element_at(F.array(*[F.lit(x) for x in _RUN_TEXTS]), (i % 4 + 1).cast("int")))
    way = text.direction(F.when(i % 11 == 0, "variable").otherwise(F.concat(i * 13 % 360, F.lit("°"))))
    return orders(spark, sf_dir).select((F.col("cust") % 100 + 1).alias("point_id"), i.alias("run_id"), (F.lit(AT) + (i % 41 - 30) * 3600).alias("reference"), speed.alias("speed"), way.alias("from_deg"), (F.lit(AT) + (i % 5 - 2) * 7200).alias("valid_until"))


@query(f"""WITH RECURSIVE {DETECTIONS_SQL}, {O}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, 3601e-2 + CAST(s_suppkey % 12 AS DOUBLE) * 75e-2 AS lat, 1002e-2 + CAST(s_suppkey % 13 AS DOUBLE) * 9e-1 AS lon FROM supplier),
    r AS (SELECT id, cust % 100 + 1 AS point_id, {AT} + (id % 41 - 30) * 3600 AS reference, [4e0, 18 / 36e-1, 9 * 514444e-6, NULL][id % 4 + 1] AS speed, CASE WHEN id % 11 <> 0 THEN CAST(id * 13 % 360 AS DOUBLE) END AS way FROM o),
    b AS (SELECT point_id, -speed * sin(radians(way)) AS bu, -speed * cos(radians(way)) AS bv FROM r WHERE reference <= {AT} AND speed IS NOT NULL AND way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY reference DESC, id DESC) = 1),
    k AS (SELECT point_id, {_WIND_KM} AS km, acq_ts, -(id % 25 / 2e0) * sin(radians(id * 37 % 360)) - coalesce(bu, 0) AS u, -(id % 25 / 2e0) * cos(radians(id * 37 % 360)) - coalesce(bv, 0) AS v FROM p LEFT JOIN b USING (point_id), d AS o WHERE acq_ts > {AT - WINDOW} AND acq_ts <= {AT}),
    w AS (SELECT *, pow(5e-1, ({AT} - acq_ts) / {WINDOW / 2}) / (km * km + 1e-2) AS w FROM k WHERE km <= 60), a AS (SELECT point_id, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v, count(*) AS n FROM w GROUP BY point_id)
    SELECT point_id, coalesce(n, 0) AS n, {_units('(coalesce(bu, 0) + coalesce(u, 0))', '1e6')} AS u_e6, {_units('(coalesce(bv, 0) + coalesce(v, 0))', '1e6')} AS v_e6 FROM p LEFT JOIN b USING (point_id) LEFT JOIN a USING (point_id) WHERE n IS NOT NULL OR bu IS NOT NULL""")
def wind_residuals(spark, sf_dir):
    """Observations as what they differ from a model's wind; points without any keep it."""
    points = sources(spark, sf_dir).withColumnRenamed("source_id", "point_id")
    found = surfaces.wind_field(points, winds(spark, sf_dir), AT, WINDOW, 60.0, surfaces.background(wind_runs(spark, sf_dir), "point_id", AT))
    return found.select("point_id", "n", units(F.col("u"), 1e6).alias("u_e6"), units(F.col("v"), 1e6).alias("v_e6"))


@query(f"""{D}, h AS (SELECT unit, CASE WHEN id % 9 <> 0 THEN CAST(id % 30 AS DOUBLE) END AS t, CASE WHEN id % 7 <> 0 THEN CAST(id * 11 % 110 AS DOUBLE) END AS rh, (id % 13) / 1e1 AS rain, row_number() OVER (PARTITION BY unit ORDER BY id) AS i FROM d),
    e AS (SELECT *, t IS NOT NULL AND rh IS NOT NULL AS known, rain >= 5e-1 AS wet, greatest(0e0, (1617e-4 - 1419e-6 * t) * pow(greatest(1e-9, -ln(1 - least(99e-2, greatest(0e0, rh / 1e2)))), 4657e-4 - 3578e-6 * t)) AS x FROM h),
    r AS (SELECT unit, CAST(0 AS BIGINT) AS i, 1e-1 AS m1, 12e-2 AS m10, 14e-2 AS m100 FROM h GROUP BY unit UNION ALL
    SELECT r.unit, e.i, {", ".join(f"CASE WHEN NOT known THEN {m} WHEN wet THEN 35e-2 + ({m} - 35e-2) * exp(-1 / {w}) ELSE x + ({m} - x) * exp(-1 / {d}) END" for m, w, d in (("m1", "1e0", "1e0"), ("m10", "25e-1", "1e1"), ("m100", "25e0", "1e2")))} FROM r JOIN e ON e.unit = r.unit AND e.i = r.i + 1)
    SELECT unit, {', '.join(f"{_units(m, '1e9')} AS {m}_e9" for m in ('m1', 'm10', 'm100'))} FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY i DESC) = 1""")
def moisture_recurrence(spark, sf_dir):
    """Temperature and humidity to equilibrium, and conditioning by it; a bin holds few of a unit's hours, so maps are composed."""
    i = F.col("id")
    celsius, humidity = F.when(i % 9 != 0, (i % 30).cast("double")), F.when(i % 7 != 0, (i * 11 % 110).cast("double"))
    hours = detections(spark, sf_dir).select("unit", i.alias("hour"), surfaces.equilibrium_moisture(humidity, celsius).alias("target"), ((i % 13) / 10.0).alias("rain"))
    found = surfaces.moisture(hours, "unit")
    return found.select("unit", *[units(F.col(m), 1e9).alias(f"{m}_e9") for m in ("m1", "m10", "m100")])


_UNIT_TEXTS = (" m/s", "ms-1", "km/h", " KMH", "kt", " kts", "Knot", " knots", "", " mph", ",5 m/s", ".25", "-1", " m / s")
_WAY_TEXTS = ("", "°", " deg", "DEG", ".5 °", " north", "e2")


@query(f"""WITH {O}, r AS (SELECT id, CASE WHEN id % 20 = 19 THEN 'fresh' ELSE (id % 60) || {list(_UNIT_TEXTS)}[id % {len(_UNIT_TEXTS)} + 1] END AS a, CASE WHEN id % 3 = 1 THEN lower({list(text.COMPASS)}[id % 16 + 1]) ELSE (id % 720) || {list(_WAY_TEXTS)}[id % {len(_WAY_TEXTS)} + 1] END AS b FROM o),
    s AS (SELECT *, replace(lower(trim(a)), ',', '.') AS w, trim(replace(replace(upper(trim(b)), '°', ''), 'DEG', '')) AS v FROM r), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(w, '^[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE) AS x, trim(regexp_replace(w, '^[0-9]+(\\.[0-9]+)?', '')) AS u FROM s)
    SELECT id, CASE WHEN w NOT SIMILAR TO '[0-9].*' THEN NULL WHEN u IN ('', 'm/s', 'ms-1') THEN x WHEN u IN ('km/h', 'kmh') THEN x / 36e-1 WHEN u IN ('kt', 'kts', 'knot', 'knots') THEN x * 514444e-6 END AS speed,
    coalesce((list_position({list(text.COMPASS)}, v) - 1) * 225e-1, CASE WHEN v SIMILAR TO '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(E[-+]?[0-9]+)?' THEN CAST(v AS DOUBLE) % 36e1 END) AS direction FROM n""")
def wind_text(spark, sf_dir):
    i = F.col("id")
    pick = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), (i % len(of) + 1).cast("int"))
    raw = F.when(i % 20 == 19, "fresh").otherwise(F.concat(i % 60, pick(_UNIT_TEXTS)))
    way = F.when(i % 3 == 1, F.lower(pick(text.COMPASS))).otherwise(F.concat(i % 720, pick(_WAY_TEXTS)))
    return orders(spark, sf_dir).select("id", text.speed(raw).alias("speed"), text.direction(way).alias("direction"))


@query("""WITH b AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'GPRMC,' || o_orderkey || ',A' AS body, CAST(o_orderkey % 9000 AS VARCHAR) AS dm FROM orders), x AS (SELECT *, list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda a, c: xor(a, c)) AS s FROM b),
    t AS (SELECT *, '$' || body || '*' || printf('%02X', CASE WHEN id % 5 = 0 THEN (s + 1) % 256 ELSE s END) AS line FROM x), p AS (SELECT *, regexp_extract(line, '^[$]([^*]*)[*]', 1) AS inner_text, regexp_extract(line, '[*]([0-9A-F]{2})$', 1) AS trailer FROM t)
    SELECT id, printf('%02X', list_reduce(list_transform(string_split(inner_text, ''), lambda c: ascii(c)), lambda a, c: xor(a, c))) = trailer AS ok, (CAST(dm AS BIGINT) // 100 + (CAST(dm AS DOUBLE) - CAST(dm AS BIGINT) // 100 * 100) / 60) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END AS degrees FROM p""")
def nmea_sentences(spark, sf_dir):
    """Sentences whose checksum is right but for every fifth, whose trailer is another number."""
    i = F.col("id")
    body = F.concat(F.lit("GPRMC,"), i.cast("string"), F.lit(",A"))
    given = F.aggregate(F.split(body, ""), F.lit(0), lambda x, c: x.bitwiseXOR(F.ascii(c)))
    trailer = F.lpad(F.hex(F.when(i % 5 == 0, (given + 1) % 256).otherwise(given)), 2, "0")
    return orders(spark, sf_dir).select("id", text.checksum_ok(F.concat(F.lit("$"), body, F.lit("*"), trailer)).alias("ok"), text.degrees_of((i % 9000).cast("string"), F.when(i % 2 == 0, "S").otherwise("N")).alias("degrees"))


_URLS = ("rtsp://u:secret@H/", "mqtts://ops@broker.example:8883/topic?x=1", "mqtt://broker.example", "no-host", "", "mqtt://u:p@:1883")


@query(f"""WITH r AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority || '!!' WHEN 1 THEN o_orderpriority || '_x_' || repeat('long name ', 6) WHEN 2 THEN '--A b--' || o_orderkey ELSE '?' || o_orderkey END AS name, o_orderkey % 400000 + 5e-1 AS age, {list(_URLS)}[o_orderkey % {len(_URLS)} + 1] AS url FROM orders),
    u AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM r), v AS (SELECT *, CASE WHEN contains(authority, '@') THEN split_part(split_part(authority, '@', 1), ':', 1) || '@' ELSE '' END AS usr, CASE WHEN contains(authority, '@') THEN split_part(authority, '@', 2) ELSE authority END AS host FROM u)
    SELECT id, left(trim(regexp_replace(lower(trim(name)), '[^a-z0-9_-]+', '-', 'g'), '-'), 48) AS slug, lpad(CAST(id % 2400 AS VARCHAR), 4, '0') AS clock, CASE WHEN age < 3600 THEN CAST(floor(age / 60) AS BIGINT) || ' min ago' WHEN age < 86400 THEN printf('%.1f h ago', age / 3600) ELSE printf('%.1f days ago', age / 86400) END AS age,
    CASE WHEN url = '' THEN '' WHEN split_part(host, ':', 1) = '' THEN '(malformed)' ELSE scheme || '://' || usr || lower(host) END AS url, coalesce(TRY_CAST(CASE WHEN id % 2 = 0 THEN 'n/a' ELSE id || '.5' END AS DOUBLE), CAST(id AS DOUBLE)) AS first_number, CASE WHEN id % 3 = 0 THEN '' ELSE substr(o_orderstatus || '-text', 1, 5) END AS cleaned,
    CASE WHEN id % 6 <> 0 THEN 1 / CAST(nullif(id % 6, 0) AS DOUBLE) END AS finite FROM v""")
def text_scalars(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    name = F.when(k % 4 == 0, F.concat(F.lit("  "), "o_orderpriority", F.lit("!!"))).when(k % 4 == 1, F.concat("o_orderpriority", F.lit("_x_"), F.repeat(F.lit("long name "), 6))).when(k % 4 == 2, F.concat(F.lit("--A b--"), k)).otherwise(F.concat(F.lit("?"), k))
    url = F.element_at(F.array(*[F.lit(u) for u in _URLS]), (k % len(_URLS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), text.slug(name).alias("slug"), text.clock(F.concat((k % 2400).cast("string"), F.lit(" h"))).alias("clock"), text.age_text(k % 400_000 + 0.5).alias("age"), text.redacted(url).alias("url"),
        text.first_number([F.when(k % 2 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".5"))), k.cast("string")]).alias("first_number"), text.clean(F.when(k % 3 != 0, F.concat(F.lit("  "), "o_orderstatus", F.lit("-text"))), 5).alias("cleaned"),
        text.finite(F.when(k % 6 == 0, F.lit(float("inf"))).otherwise(1 / (k % 6).cast("double"))).alias("finite"),
    )


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 43200e0 ELSE 36000e0 END END AS epoch, epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + CASE WHEN o_orderkey % 3 = 0 THEN 21600 ELSE 86400 END < 820454400 AS stale FROM orders""")
def time_scalars(spark, sf_dir):
    k, day = F.col("o_orderkey").cast("long"), F.col("o_orderdate").cast("date").cast("string")
    iso = F.when(k % 5 == 0, "soon").otherwise(F.concat(day, F.when(k % 2 == 0, "T12:00:00Z").otherwise("T12:00:00+02:00")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.epoch(iso).alias("epoch"), text.stale(F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * DAY, k % 3 == 0, NOW).alias("stale"))


@query(f"""{D} SELECT id, {_units('((degrees(atan2(sin(radians(longitude - 14)) * cos(radians(latitude)), cos(radians(40e0)) * sin(radians(latitude)) - sin(radians(40e0)) * cos(radians(latitude)) * cos(radians(longitude - 14)))) + 360) % 36e1)', '1e6')} AS bearing_e6, {_units('radians(longitude) * 6378137e0', '1e3')} AS x_mm, {_units('ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137e0', '1e3')} AS y_mm,
    {_units('(longitude * 20 - 1005e-1 - 360 * floor((longitude * 20 - 1005e-1 - 179 + 180) / 36e1))', '1e6')} AS unwrapped_e6, floor(longitude / 5e-1) * 5e-1 AS snapped_west, least(9e1, latitude * 3) AS clamped_lat FROM d""")
def geo_scalars(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    x, y = geo.mercator(lat, lon)
    return detections(spark, sf_dir).select(
        "id", units(geo.bearing(F.lit(40.0), F.lit(14.0), lat, lon), 1e6).alias("bearing_e6"), units(x, 1e3).alias("x_mm"), units(y, 1e3).alias("y_mm"), units(geo.unwrapped(lon * 20 - 100.5, F.lit(179.0)), 1e6).alias("unwrapped_e6"),
        geo.snapped(lon, lon, 0.5)[0].alias("snapped_west"), geo.clamped(lat * 3, lon)[0].alias("clamped_lat"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
