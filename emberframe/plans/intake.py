"""Queries of feeds and stored tables over the driver's tables, with their DuckDB SQL.

Payloads are texts made from detections, fifty to a CSV response and a unit's of a day to a sentence burst, hostile ones among them; what is
parsed must give the columns that they were made from back, which the SQL takes from the events themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.plans.incidents import _units, units
from emberframe.session import shuffle_partitions, table, work_dir
from emberframe.sources import documents, feeds, store
from emberframe.sources.detections import DETECTIONS_SQL, detections

TODAY, NOW = "2024-01-31", 1_706_700_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D = f"WITH RECURSIVE {DETECTIONS_SQL}"


def query(sql: str) -> Callable:
    """Registers a query with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


BODIES = ("Invalid MAP_KEY.", "Exceeding allowed transaction limit", "Invalid range", "Invalid source X", "<html>503</html>", "Nothing here", "")


def csv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_id, source, body: fifty detections each; one payload in nine is a failure's text."""
    i = F.col("id")
    text = lambda c: F.col(c).cast("string")
    lat = F.when(i % 41 == 0, "n/a").otherwise(text("latitude"))
    day = F.when(i % 47 == 0, "2024-13-01").when(i % 53 == 0, "").otherwise(text("acq_date"))
    time = F.when(i % 43 == 0, "noon").otherwise((F.hour(F.timestamp_seconds("acq_ts")) * 100 + F.minute(F.timestamp_seconds("acq_ts"))).cast("string"))
    satellite = F.when(i % 29 == 0, '"N,""20"""').otherwise(F.col("satellite"))
    confidence = F.when(i % 3 == 0, F.substring("confidence_level", 1, 1)).otherwise(text("confidence_pct"))
    line = F.concat_ws(",", lat, text("longitude"), F.lit("330.5"), text("scan"), text("track"), day, time, satellite, F.col("instrument"), confidence, F.concat(F.lit("v"), i), F.lit("x"), F.coalesce(text("frp"), F.lit("")), F.when(i % 2 == 0, "Day").otherwise(" n"))
    head = lambda a, b: f"latitude, Longitude,{a},scan,track,acq_date,acq_time,satellite,instrument,confidence,version,{b},frp,daynight"
    lines = detections(spark, sf_dir).select(F.floor(i / 50).alias("payload_id"), i.alias("id"), line.alias("line")).groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"))
    p = F.col("payload_id")
    body = F.concat(F.when(p % 2 == 0, head("bright_ti4", "bright_ti5")).otherwise(head("brightness", "bright_t31")), F.lit("\r\n"), F.array_join("l.line", "\n"))
    failure = F.element_at(F.array(*[F.lit(b) for b in BODIES]), (p / 9 % len(BODIES) + 1).cast("int"))
    return lines.select("payload_id", F.concat(F.lit("S"), p % 3).alias("source"), F.when(p % 9 == 0, failure).otherwise(body).alias("body"))


@query("""WITH p AS (SELECT DISTINCT event_id // 50 AS payload_id FROM events) SELECT payload_id, CASE WHEN payload_id % 9 = 0 THEN ['key', 'rate_limit', 'day_range', 'source', 'unexpected', 'unrecognised', 'unrecognised'][payload_id // 9 % 7 + 1] END AS failure FROM p""")
def payload_failures(spark, sf_dir):
    return csv_payloads(spark, sf_dir).select("payload_id", feeds.failure_of(F.col("body")).alias("failure"))


@query(f"""{D} SELECT id // 50 AS payload_id, 'v' || id AS version, CASE WHEN id % 29 = 0 THEN 'N,"20"' ELSE satellite END AS satellite, instrument, round(latitude, 5) AS latitude, round(longitude, 5) AS longitude, strftime(acq_date, '%Y-%m-%d') AS acq_date, strftime(to_timestamp(acq_ts), '%H%M') AS acq_time, acq_ts // 60 * 60 AS acq_ts, 3305e-1 AS brightness,
    scan, track, CASE WHEN id % 3 = 0 THEN NULL ELSE confidence_pct END AS confidence_pct, confidence_level, frp, CASE WHEN id % 2 = 0 THEN 'D' ELSE 'N' END AS daynight FROM d WHERE id // 50 % 9 <> 0 AND id % 41 <> 0 AND id % 43 <> 0 AND id % 47 <> 0 AND id % 53 <> 0""")
def csv_detections(spark, sf_dir):
    found = feeds.detections_of(csv_payloads(spark, sf_dir))[0]
    return found.select("payload_id", "version", "satellite", "instrument", "latitude", "longitude", "acq_date", "acq_time", "acq_ts", "brightness", "scan", "track", "confidence_pct", "confidence_level", "frp", "daynight")


@query("""SELECT event_id // 50 AS payload_id, event_id % 50 + 1 AS line, CASE WHEN event_id % 41 = 0 THEN 'position' WHEN event_id % 53 = 0 AND event_id % 47 <> 0 THEN 'acq_date' WHEN event_id % 43 = 0 THEN 'acq_time' ELSE 'timestamp' END AS reason FROM events WHERE event_id // 50 % 9 <> 0 AND (event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 53 = 0)""")
def csv_refused(spark, sf_dir):
    return feeds.detections_of(csv_payloads(spark, sf_dir))[1].withColumn("line", F.col("line").cast("long"))


def sentence_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_id, callsign, received, body: two sentences for each detection of a unit on a day."""
    i = F.col("id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.timestamp_seconds("acq_ts")
    time, date = F.date_format(at, "HHmmss"), F.date_format(at, "ddMMyy")
    lat, lon = F.concat(two(36 + F.col("unit") % 9), two(i % 60), F.lit("."), (i % 10).cast("string"), F.lit("000")), F.concat(F.lit("0"), two(10 + F.col("unit") % 10), two(i * 7 % 60), F.lit("."), (i % 10).cast("string"), F.lit("00"))
    rmc = F.concat_ws(",", F.lit("GPRMC"), time, F.when(i % 13 == 0, "V").otherwise("A"), lat, F.lit("N"), lon, F.when(i % 2 == 0, "W").otherwise("E"), (i % 40).cast("string"), F.when(i % 4 == 0, "").otherwise((i % 360).cast("string")), date, F.lit(""))
    gga = F.concat_ws(",", F.lit("GPGGA"), time, lat, F.lit("N"), lon, F.when(i % 2 == 0, "W").otherwise("E"), F.when(i % 11 == 0, "0").otherwise("1"), F.lit("08"), F.concat((i % 9).cast("string"), F.lit(".5")), (i % 500).cast("string"), F.lit("M"), F.lit(""), F.lit("M"), F.lit(""))
    check = lambda b: F.lpad(F.hex(F.aggregate(F.split(b, ""), F.lit(0), lambda x, c: x.bitwiseXOR(F.ascii(c)))), 2, "0")
    whole = lambda b: F.concat(F.lit("$"), b, F.lit("*"), check(b))
    seen = detections(spark, sf_dir).select("id", "unit", "acq_ts").repartition(shuffle_partitions(spark))  # by their number: a file of few bytes is one task
    rows = seen.select("id", "unit", "acq_ts", (F.col("unit") * 1000 + F.floor(F.col("acq_ts") / 86_400) % 1000).alias("payload_id"), F.concat(whole(rmc), F.lit("\r\n"), F.lit("garbage\r\n"), whole(gga)).alias("lines"))
    burst = rows.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "lines"))), lambda x: x["lines"]), "\n").alias("body"), F.max("acq_ts").alias("received"))
    p = F.col("payload_id")
    bad = F.when(p % 17 == 0, F.regexp_replace("body", r"\*..$", "*ZZ")).when(p % 19 == 0, "$GPGSV,1,1").otherwise(F.col("body"))
    return burst.select("payload_id", F.when(p % 23 == 0, " ").otherwise(F.concat(F.lit("T"), p)).alias("callsign"), "received", bad.alias("body"))


_BURST = f"{D}, s AS (SELECT *, unit * 1000 + acq_ts // 86400 % 1000 AS payload_id, id % 13 <> 0 AS rmc, id % 11 <> 0 AS gga FROM d), ok AS (SELECT *, payload_id % 17 <> 0 AND payload_id % 19 <> 0 AND payload_id % 23 <> 0 AS taken FROM s)"


@query(f"""{_BURST} SELECT payload_id, acq_ts AS observed, {_units('arg_max(36 + unit % 9 + (id % 60 + (id % 10) / 1e1) / 6e1, id)', '1e7')} AS lat_e7, {_units('arg_max((10 + unit % 10 + (id * 7 % 60 + (id % 10) / 1e1) / 6e1) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END, id)', '1e7')} AS lon_e7,
    arg_max(round(id % 40 * 1852e-3, 3), id) FILTER (rmc) AS speed_kmh, arg_max(CAST(id % 360 AS DOUBLE), id) FILTER (rmc AND id % 4 <> 0) AS heading, arg_max(CAST(id % 500 AS DOUBLE), id) FILTER (gga) AS altitude_m, arg_max(round((id % 9 + 5e-1) * 5, 1), id) FILTER (gga) AS accuracy_m,
    CASE WHEN bool_or(gga) THEN 'GGA' ELSE '' END || CASE WHEN bool_or(gga) AND bool_or(rmc) THEN ',' ELSE '' END || CASE WHEN bool_or(rmc) THEN 'RMC' ELSE '' END AS sentences FROM ok WHERE taken AND (rmc OR gga) GROUP BY payload_id, acq_ts""")
def nmea_reports(spark, sf_dir):
    found = feeds.fixes_of(sentence_payloads(spark, sf_dir))[0]
    return found.select("payload_id", F.col("observed").cast("long").alias("observed"), units(F.col("latitude"), 1e7).alias("lat_e7"), units(F.col("longitude"), 1e7).alias("lon_e7"), "speed_kmh", "heading", "altitude_m", "accuracy_m", "sentences")


@query(f"""{_BURST} SELECT payload_id, CASE WHEN payload_id % 23 = 0 THEN 'callsign' WHEN payload_id % 17 = 0 THEN 'checksum' WHEN payload_id % 19 = 0 THEN 'no_positions' ELSE 'no_fix' END AS reason FROM ok GROUP BY payload_id HAVING NOT bool_or(taken AND (rmc OR gga))""")
def nmea_refused(spark, sf_dir):
    return feeds.fixes_of(sentence_payloads(spark, sf_dir))[1]


@query(f"""{D}, l AS (SELECT 1 AS load, d.* FROM d WHERE id % 10 < 7 UNION ALL SELECT 2, d.* REPLACE (frp + 1 AS frp) FROM d WHERE id % 10 >= 4) SELECT source, satellite, unit, acq_date, id, frp FROM l QUALIFY row_number() OVER (PARTITION BY source, satellite, unit, acq_date ORDER BY load DESC, id DESC) = 1""")
def detections_merged(spark, sf_dir):
    """Two loads that overlap, the second one revised and run twice, into one table stored by day: a row per key."""
    path, key = work_dir(spark, "detections"), ("source", "satellite", "unit", "acq_date")
    seen = detections(spark, sf_dir).select(*key, "id", "frp")
    store.merge(seen.where("id % 10 < 7"), path, key, "acq_date", "id")
    revised = seen.where("id % 10 >= 4").withColumn("frp", F.col("frp") + 1)
    store.merge(revised, path, key, "acq_date", "id")
    return store.merge(revised, path, key, "acq_date", "id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage as detections would have left it: a record per source, cell and day, and some of the whole world."""
    i = F.col("id")
    cell = [F.floor((F.col("longitude") + 180) / 0.5).alias("cell_x"), F.floor((F.col("latitude") + 90) / 0.5).alias("cell_y")]
    own = detections(spark, sf_dir).groupBy("source", *cell, F.col("acq_date").alias("day")).agg(F.max("acq_ts").alias("fetched_at"), F.max(i).alias("id"))
    world = own.where("id % 97 = 0").groupBy("source", "day").agg(F.max("fetched_at").alias("fetched_at"), F.max("id").alias("id")).select("source", *[F.lit(store.WORLD).cast("long").alias(c) for c in ("cell_x", "cell_y")], "day", "fetched_at", "id")
    return own.unionByName(world).select("source", "cell_x", "cell_y", "day", "fetched_at", F.when(i % 5 == 0, "error").otherwise("ok").alias("status"))


def watch_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per nation; one is across 180 degrees, one too wide for single cells."""
    n = F.col("n_nationkey").cast("double")
    west = F.when(n == 7, 179.2).when(n == 8, -20.0).otherwise(10.0 + n / 3)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("box_id"), west.alias("west"), F.lit(36.2).alias("south"), F.when(n == 7, -179.4).when(n == 8, 20.0).otherwise(west + 0.9).alias("east"), F.lit(37.4).alias("north"))


_MISSING = f"""{D}, b AS (SELECT n_nationkey AS box_id, CASE n_nationkey WHEN 7 THEN 1792e-1 WHEN 8 THEN -2e1 ELSE 1e1 + CAST(n_nationkey AS DOUBLE) / 3 END AS west FROM nation), e AS (SELECT *, CASE box_id WHEN 7 THEN -1794e-1 WHEN 8 THEN 2e1 ELSE west + 9e-1 END AS east FROM b),
  q AS (SELECT box_id, west AS w, CASE WHEN west <= east THEN east ELSE 18e1 END AS e FROM e UNION ALL SELECT box_id, -18e1, east FROM e WHERE west > east),
  c AS (SELECT DISTINCT box_id, x.i AS cell_x, y.i AS cell_y FROM q, range(720) AS x(i), range(360) AS y(i) WHERE x.i BETWEEN floor((w + 180) / 5e-1) AND floor((e - 1e-9 + 180) / 5e-1) AND y.i BETWEEN floor((362e-1 + 90) / 5e-1) AND floor((374e-1 - 1e-9 + 90) / 5e-1)),
  k AS (SELECT DISTINCT CASE WHEN n > 64 THEN -1 ELSE cell_x END AS cell_x, CASE WHEN n > 64 THEN -1 ELSE cell_y END AS cell_y FROM (SELECT *, count(*) OVER (PARTITION BY box_id) AS n FROM c)),
  o AS (SELECT source, CAST(floor((longitude + 180) / 5e-1) AS BIGINT) AS cell_x, CAST(floor((latitude + 90) / 5e-1) AS BIGINT) AS cell_y, acq_date AS day, max(acq_ts) AS fetched_at, max(id) AS id FROM d GROUP BY ALL),
  l AS (SELECT * FROM o UNION ALL SELECT source, -1, -1, day, max(fetched_at), max(id) FROM o WHERE id % 97 = 0 GROUP BY source, day),
  a AS (SELECT s.source, k.cell_x, k.cell_y, CAST(g.x AS DATE) AS day FROM k, (SELECT DISTINCT source FROM d) AS s, generate_series(DATE '2024-01-20', DATE '{TODAY}', INTERVAL 1 DAY) AS g(x)),
  j AS (SELECT a.*, coalesce(p.fetched_at, w.fetched_at) AS since, coalesce(p.id, w.id) % 5 = 0 AS failed FROM a LEFT JOIN l AS p ON p.source = a.source AND p.cell_x = a.cell_x AND p.cell_y = a.cell_y AND p.day = a.day LEFT JOIN l AS w ON w.source = a.source AND w.cell_x = -1 AND w.cell_y = -1 AND w.day = a.day),
  m AS (SELECT source, cell_x, cell_y, day FROM j WHERE since IS NULL OR (failed AND {NOW} - since > 600) OR (NOT failed AND day >= DATE '{TODAY}' - 1 AND {NOW} - since > 2700))"""


def wanted(spark, sf_dir):
    cells = store.cells_of_boxes(watch_boxes(spark, sf_dir), 0.5, 64)
    days = spark.sql(f"SELECT explode(sequence(DATE'2024-01-20', DATE'{TODAY}')) AS day")
    sources = detections(spark, sf_dir).select("source").distinct()
    return store.days_to_fetch(cells, sources, days, ledger(spark, sf_dir), TODAY, NOW)


@query(f"{_MISSING} SELECT * FROM m")
def days_to_fetch(spark, sf_dir):
    return wanted(spark, sf_dir)


@query(f"""{_MISSING}, r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY source, cell_x, cell_y ORDER BY day) AS INT) AS island FROM m), h AS (SELECT *, (row_number() OVER (PARTITION BY source, cell_x, cell_y, island ORDER BY day) - 1) // 5 AS chunk FROM r)
    SELECT source, cell_x, cell_y, min(day) AS first_day, max(day) AS last_day, count(*) AS days, CAST(DATE '{TODAY}' - max(day) AS BIGINT) AS priority FROM h GROUP BY source, cell_x, cell_y, island, chunk""")
def fetch_tasks(spark, sf_dir):
    return store.fetch_tasks(wanted(spark, sf_dir), TODAY, 5)


def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_id, body: an alert per order, some in a feed, in two languages, drafts, cancellations and hostile ones among them."""
    i = F.col("o_orderkey").cast("long")
    n = i.cast("string")
    say = lambda lang, event: F.concat(F.lit(f"<cap:info><cap:language>{lang}</cap:language><cap:event>{event}</cap:event><cap:urgency>Immediate</cap:urgency><cap:severity>"), F.when(i % 4 == 0, "Extreme").when(i % 4 == 1, "Minor").when(i % 4 == 2, "Dire").otherwise(""), F.lit("</cap:severity><cap:headline>  H "), n, F.lit(" &amp; more</cap:headline><cap:area><cap:areaDesc>A</cap:areaDesc><cap:polygon>"), F.concat_ws(" ", F.concat(F.when(i % 23 == 0, "x").otherwise((i % 50).cast("string")), F.lit(",10")), F.concat((i % 50).cast("string"), F.lit(",11.5")), F.concat((i % 50 + 1).cast("string"), F.lit(",11"))), F.lit("</cap:polygon></cap:area></cap:info>"))
    infos = F.when(i % 5 == 0, F.concat(say("en-GB", "Fire"), say("de-DE", "Feuer"))).when(i % 5 == 1, F.concat(say("fr", "Feu"), say("EN", "Fire"))).when(i % 5 == 2, say("fr", "Feu")).when(i % 5 == 3, say("de", "Feuer")).otherwise("")
    status = F.when(i % 7 == 0, "Exercise").when(i % 7 == 1, "").otherwise("Actual")
    kind = F.when(i % 2 == 0, "Cancel").otherwise("Alert")
    alert = F.concat(F.lit('<cap:alert xmlns:cap="urn:oasis:names:tc:emergency:cap:1.2"><cap:identifier>'), F.when(i % 29 == 0, " ").otherwise(F.concat(F.lit("id-"), n)), F.lit("</cap:identifier><cap:sender>s</cap:sender><cap:status>"), status, F.lit("</cap:status><cap:msgType>"), kind, F.lit("</cap:msgType>"), infos, F.lit("</cap:alert>"))
    body = F.when(i % 31 == 0, F.concat(F.lit('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>'), alert)).when(i % 37 == 0, "<feed></feed>").when(i % 3 == 0, F.concat(F.lit("<feed><entry>"), alert, F.lit("</entry></feed>"))).otherwise(alert)
    return table(spark, sf_dir, "orders").select(i.alias("payload_id"), body.alias("body"))


_ALERTS = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders), r AS (SELECT *, i % 31 = 0 AS declared, i % 37 = 0 AS none, i % 7 = 0 AS draft, i % 5 = 4 AS bare, i % 29 = 0 AS unnamed, i % 23 = 0 AS broken FROM o),
    j AS (SELECT *, CASE WHEN declared THEN 'declaration' WHEN none THEN 'no_alert' WHEN draft OR (bare AND i % 2 = 0 AND NOT unnamed) THEN 'silent' WHEN unnamed THEN 'identifier' WHEN bare THEN 'no_info' WHEN broken THEN 'polygon' END AS reason FROM r)"""


@query(f"""{_ALERTS} SELECT i AS payload_id, 'id-' || i AS identifier, CASE i % 5 WHEN 0 THEN 'de-de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'de' END AS language, CASE i % 5 WHEN 0 THEN 'Feuer' WHEN 1 THEN 'Fire' WHEN 2 THEN 'Feu' ELSE 'Feuer' END AS event, CASE i % 4 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Dire' ELSE 'Unknown' END AS severity,
    CAST(CASE i % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS INT) AS severity_rank, 'H ' || i || ' & more' AS headline, CAST(4 AS BIGINT) AS points, CAST(i % 50 AS DOUBLE) AS south FROM j WHERE reason IS NULL""")
def cap_alerts(spark, sf_dir):
    taken = documents.alerts_of(alert_payloads(spark, sf_dir))[0]
    ring = F.get("rings", F.lit(0))
    return taken.select("payload_id", "identifier", "language", "event", "severity", "severity_rank", "headline", F.size(ring).cast("long").alias("points"), F.array_min(ring["y"]).alias("south"))


@query(f"{_ALERTS} SELECT i AS payload_id, reason FROM j WHERE reason <> 'silent'")
def cap_refused(spark, sf_dir):
    return documents.alerts_of(alert_payloads(spark, sf_dir))[1]


def feature_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_id, body: a collection of a customer's orders as points, lines and rings."""
    i, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    x, y = (i % 300 - 120).cast("string"), (i % 80).cast("string")
    at = lambda dx, dy: F.concat(F.lit("["), (i % 300 - 120 + dx).cast("string"), F.lit(","), (i % 80 + dy).cast("string"), F.lit("]"))
    shape = F.when(i % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(","), y, F.lit(",5]}"))).when(i % 3 == 1, F.concat(F.lit('{"type":"LineString","coordinates":['), at(0, 0), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit(","), at(1, 1))), F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", at(0, 0), at(1, 0), at(1, 1), F.when(i % 13 == 0, at(2, 2)).otherwise(at(0, 0))), F.lit("]]}")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.when(i % 997 == 0, "null").otherwise(shape), F.lit(',"properties":{"name":"n'), i.cast("string"), F.lit('","k":'), (i % 5).cast("string"), F.lit("}}"))
    all_ = table(spark, sf_dir, "orders").select(c.alias("payload_id"), i.alias("i"), feature.alias("f")).groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda r: r["f"]), ",").alias("fs"))
    p = F.col("payload_id")
    system = F.when(p % 31 == 0, '"crs":{"type":"name","properties":{"name":"EPSG:25832"}},').when(p % 29 == 0, '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},').otherwise("")
    body = F.when(p % 37 == 0, "{not json").when(p % 41 == 0, '{"type":"Point"}').otherwise(F.concat(F.lit('{"type":"FeatureCollection",'), system, F.lit('"features":['), "fs", F.lit("]}")))
    return all_.select("payload_id", body.alias("body"))


_FEATURES = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_custkey AS BIGINT) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders), w AS (SELECT p, CASE WHEN p % 37 = 0 THEN 'not_json' WHEN p % 41 = 0 THEN 'not_features' WHEN p % 31 = 0 THEN 'reference_system' WHEN bool_or(i % 997 = 0) THEN 'no_geometry' END AS whole FROM o GROUP BY p),
    f AS (SELECT o.*, whole, CASE WHEN i % 300 - 120 + CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN i % 11 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN i % 13 = 0 THEN 2 ELSE 1 END END > 180 THEN 'coordinates' WHEN i % 3 = 1 AND i % 11 = 0 THEN 'too_few_points' WHEN i % 3 = 2 AND i % 13 = 0 THEN 'open_ring' END AS own FROM o JOIN w USING (p))"""


@query(f"""{_FEATURES} SELECT p AS payload_id, CAST(place AS INT) AS place, ['Point', 'LineString', 'Polygon'][i % 3 + 1] AS kind, CAST([1, 2, 4][i % 3 + 1] AS BIGINT) AS points, CAST(i % 300 - 120 AS DOUBLE) AS x, CAST(i % 80 AS DOUBLE) AS y, 'n' || i AS name FROM f WHERE whole IS NULL AND own IS NULL""")
def geojson_features(spark, sf_dir):
    taken = documents.features_of(feature_payloads(spark, sf_dir))[0]
    first = F.get("points", F.lit(0))
    return taken.select("payload_id", "place", "kind", F.size("points").cast("long").alias("points"), first["x"].alias("x"), first["y"].alias("y"), "name")


@query(f"{_FEATURES} SELECT DISTINCT p AS payload_id, CAST(NULL AS INT) AS place, whole AS reason FROM f WHERE whole IS NOT NULL UNION ALL SELECT p, CAST(place AS INT), own FROM f WHERE whole IS NULL AND own IS NOT NULL")
def geojson_refused(spark, sf_dir):
    return documents.features_of(feature_payloads(spark, sf_dir))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
