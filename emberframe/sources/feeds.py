"""Payloads as rows: detection CSV and position sentences, parsed by expressions, with what is refused beside what is taken.

A payload is a row (payload_id, ..., body). Its lines become rows of their own, so parsing is as wide as the lines are many; only what
concerns a payload as a whole (its class, its date, whether it is refused) is summed per payload and joined back.

Defined results. A null or empty body is refused. A line break inside a quoted CSV field ends the line. CSV rows without a position, a
date or a time are refused, one by one, with a reason. A sentence payload is refused as a whole for one wrong checksum, for
coordinates or times that can't be read, without RMC or GGA sentences, and without a callsign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.text import clock
from emberframe.operators.workspace import first_failure
from emberframe.session import cut, shuffle_partitions
from emberframe.sources.detections import normalise_confidence

FIELDS = 40  #: of a CSV line at most; a line of more is refused
# fixed values: columns by the products that use them
BRIGHTNESS = ("bright_ti4", "brightness", "bright_t4")
BRIGHTNESS2 = ("bright_ti5", "bright_t31", "bright_t5")
# fixed values of sentences
KMH_PER_KNOT, METRES_PER_HDOP = 1.852, 5.0
FIXES = ("1", "2", "3", "4", "5", "7", "8", "9")


def failure_of(body: Column) -> Column:
    """The kind of failure that a response's text stands for, or null where it is detections."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 600))
    has = lambda *words: _any(head, words)
    rules = [
        ("key", (has("map_key") & has("invalid")) | has("invalid mapkey")), ("rate_limit", has("transaction limit", "rate limit", "too many")), ("day_range", has("day range", "invalid range")),
        ("source", has("invalid source", "unknown source", "not a valid source")), ("unexpected", has("invalid", "error") | F.ltrim(head).startswith("<")), ("unrecognised", ~(has("latitude") & has("longitude"))),
    ]
    return first_failure(rules)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _lines(payloads: DataFrame, key: str) -> DataFrame:
    """payloads' lines (key, line from 0, text), empty ones left out."""
    return payloads.select(key, F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "text")).where(F.trim("text") != "")


def _number(value: Column) -> Column:
    text = F.trim(value)
    found = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)


def _fields(payloads: DataFrame) -> DataFrame:
    """payload_id, source, line, names, cells: each line after the first of the payloads (payload_id, source, body) that are detections, its fields (null for more than FIELDS) and the first line's names.

    The names are read before lines become rows, so that a payload is neither summed nor joined, and each line is parsed once.
    """
    schema = ", ".join(f"c{i} string" for i in range(FIELDS + 1))
    parsed = lambda text: F.from_csv(text, schema, {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    # by a lambda's variable: a field of from_csv by name becomes a parse of its own for each of them
    read = lambda text: F.get(F.transform(F.array(parsed(text)), lambda f: F.array(*[f[f"c{i}"] for i in range(FIELDS + 1)])), F.lit(0))
    lines = F.filter(F.transform(F.split("body", r"\r\n|\r|\n"), lambda t, i: F.struct(i.alias("line"), t.alias("text"))), lambda x: F.trim(x["text"]) != "")
    good = payloads.where(failure_of(F.col("body")).isNull()).select("payload_id", "source", lines.alias("lines")).withColumn("head", read(F.get("lines", F.lit(0))["text"]))
    names = F.filter(F.transform("head", lambda h: F.lower(F.trim(h))), lambda h: h.isNotNull() & (h != ""))
    told = F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.struct(x["line"].alias("line"), read(x["text"]).alias("cells")))
    # parsed before lines become rows: above that step each use of a field would parse the line again
    split = good.select("payload_id", "source", names.alias("names"), "lines").select("payload_id", "source", "names", F.explode(told).alias("l"))
    return split.select("payload_id", "source", "l.line", "names", F.when(F.element_at("l.cells", FIELDS + 1).isNull(), F.col("l.cells")).alias("cells"))


def _mapped(fields: DataFrame) -> Column:
    return F.when(F.col("cells").isNotNull(), F.map_from_entries(F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.struct(F.element_at("names", i), F.get("cells", i - 1)))))


def csv_rows(payloads: DataFrame) -> DataFrame:
    """payload_id, source, line, row (map of lower-case names to text, or null where a line has more than FIELDS) of the payloads (payload_id, source, body) that are detections."""
    rows = _fields(payloads)
    return rows.select("payload_id", "source", "line", _mapped(rows).alias("row"))


def detections_of(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections, refused rows with a reason) of CSV payloads (payload_id, source, body)."""
    wanted = ("satellite", "instrument", "latitude", "longitude", "acq_date", "acq_time", *BRIGHTNESS, *BRIGHTNESS2, "scan", "track", "confidence", "frp", "daynight", "version")
    rows = _fields(payloads)
    at = lambda n: F.nullif(F.array_position("names", n), F.lit(0))
    rows = rows.select("payload_id", "source", "line", _mapped(rows).alias("row"), F.col("cells").isNull().alias("long"), *[F.get("cells", (at(n) - 1).cast("int")).alias(f"v_{n}") for n in wanted])
    get = lambda c: F.trim(F.coalesce(F.col(f"v_{c}"), F.lit("")))
    text = lambda c: F.nullif(get(c), F.lit(""))
    number = lambda *names: F.coalesce(*[_number(F.col(f"v_{n}")) for n in names])
    percent, level = normalise_confidence(get("confidence"))
    time = clock(get("acq_time"))
    stamp = F.try_to_timestamp(F.concat(get("acq_date"), F.lit(" "), time), F.lit("yyyy-MM-dd HHmm"))
    parsed = rows.select(
        "payload_id", "source", "line", text("satellite").alias("satellite"), text("instrument").alias("instrument"), F.round(number("latitude"), 5).alias("latitude"), F.round(number("longitude"), 5).alias("longitude"), text("acq_date").alias("acq_date"),
        time.alias("acq_time"), F.unix_timestamp(stamp).alias("acq_ts"), number(*BRIGHTNESS).alias("brightness"), number(*BRIGHTNESS2).alias("brightness2"), number("scan").alias("scan"), number("track").alias("track"), text("confidence").alias("confidence_raw"),
        percent.alias("confidence_pct"), level.alias("confidence_level"), number("frp").alias("frp"), F.nullif(F.substring(F.upper(get("daynight")), 1, 1), F.lit("")).alias("daynight"), text("version").alias("version"), F.to_json("row").alias("raw_json"), "long",
    )
    reason = first_failure([("too_many_fields", F.col("long")), ("position", F.col("latitude").isNull() | F.col("longitude").isNull()), ("acq_date", F.col("acq_date").isNull()), ("acq_time", F.col("acq_time").isNull()), ("timestamp", F.col("acq_ts").isNull())])
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason", "long"), judged.where("reason IS NOT NULL").select("payload_id", "line", "reason")


def sentence_ok(sentence: Column) -> Column:
    """Whether the checksum after * is that of the characters before it (without leading $ and !); a sentence without one is taken."""
    body, declared = F.substring_index(F.regexp_replace(sentence, r"^[$!]+", ""), "*", 1), F.trim(F.regexp_extract(sentence, r"\*(.*)$", 1))
    found = F.aggregate(F.split(body, ""), F.lit(0), lambda x, c: x.bitwiseXOR(F.ascii(c)))
    two = F.substring(declared, 1, 2)
    return ~F.contains(sentence, F.lit("*")) | F.coalesce(F.when(two.rlike("^[0-9A-Fa-f]{2}$"), F.conv(two, 16, 10).cast("int") == found), F.lit(False))


def _degrees(value: Column, hemisphere: Column, width: int) -> Column:
    """Signed degrees of ddmm.mmmm (two or three digits of degrees); null where they can't be read."""
    raw = F.trim(value)
    shaped = raw.rlike(rf"^[0-9]{{{width},}}(\.[0-9]*)?$")
    minutes = F.substring(raw, width + 1, 30).try_cast("double")
    found = F.substring(raw, 1, width).cast("double") + minutes / 60
    return F.when(shaped & (minutes < 60), F.when(F.upper(F.trim(hemisphere)).isin("S", "W"), -found).otherwise(found))


def fixes_of(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(position reports, refused payloads with a reason) of sentence payloads (payload_id, callsign, received, body).

    RMC and GGA sentences of one instant are one report: speed and course of the one, altitude and accuracy of the other. A GGA has the
    date of the payload's first RMC, else the day of receipt (epoch seconds). Sentences are parsed once and stored, since payloads are judged by all of theirs.
    """
    # by their number: payloads are few bytes for the work in them, so Spark would put many of them into one task
    dealt = payloads.select("payload_id", "body").repartition(shuffle_partitions(payloads.sparkSession))
    lines = _lines(dealt, "payload_id").withColumn("text", F.trim("text")).where(F.substring("text", 1, 1).isin("$", "!"))
    f = F.split(F.regexp_replace(F.substring_index("text", "*", 1), r"^[$!]+", ""), ",")
    kind = F.substring(F.get(f, F.lit(0)), -3, 3)
    told = lines.select("payload_id", "line", sentence_ok(F.col("text")).alias("ok"), f.alias("f"), kind.alias("kind"))
    at = lambda i: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit("")))
    rmc, gga = F.col("kind") == "RMC", F.col("kind") == "GGA"
    full = F.size("f") >= 10
    fixed = full & ((rmc & (F.upper(F.substring(at(2), 1, 1)) == "A")) | (gga & at(6).isin(*FIXES)))
    pick = lambda a, b: F.when(rmc, a).otherwise(b)
    number = lambda c: F.when(c != "", c.try_cast("double"))
    parsed = told.select(
        "payload_id", "line", "ok", "kind", F.coalesce(rmc | gga, F.lit(False)).alias("position"), fixed.alias("fixed"), pick(_degrees(at(3), at(4), 2), _degrees(at(2), at(3), 2)).alias("latitude"), pick(_degrees(at(5), at(6), 3), _degrees(at(4), at(5), 3)).alias("longitude"), at(1).alias("time"), F.when(rmc & full, F.nullif(at(9), F.lit(""))).alias("date"),
        F.when(rmc, F.round(number(at(7)) * KMH_PER_KNOT, 3)).alias("speed_kmh"), F.when(rmc, F.pmod(number(at(8)), F.lit(360.0))).alias("heading"), F.when(gga, number(at(9))).alias("altitude_m"), F.when(gga, F.round(number(at(8)) * METRES_PER_HDOP, 1)).alias("accuracy_m"),
    )
    parsed = cut(parsed)
    sentences = parsed.where("position")
    whole = parsed.groupBy("payload_id").agg(F.bool_and("ok").alias("checked"), F.sum(F.col("position").cast("int")).alias("positions"))
    dated = sentences.groupBy("payload_id").agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.col("line"))).alias("day"))
    day = F.coalesce("date", "day")
    # a two-digit year of 69 or more belongs to the last century
    year = F.substring(day, 5, 2).try_cast("int")
    stated = F.when(F.length(day) == 6, F.try_to_timestamp(F.concat_ws("-", (year + F.when(year >= 69, 1900).otherwise(2000)).cast("string"), F.substring(day, 3, 2), F.substring(day, 1, 2)), F.lit("y-MM-dd")))
    midnight = F.when(F.length(day) == 6, F.unix_timestamp(stated)).otherwise(F.floor(F.col("received") / 86_400) * 86_400)
    part = lambda i: F.substring("time", i, 2)
    seconds = F.substring("time", 5, 20).try_cast("double")
    clock_ok = (F.length("time") >= 6) & part(1).rlike("^[0-9]{2}$") & part(3).rlike("^[0-9]{2}$") & (part(1).try_cast("int") < 24) & (part(3).try_cast("int") < 60)
    observed = F.when(clock_ok, midnight + part(1).try_cast("int") * 3600 + part(3).try_cast("int") * 60 + seconds)
    placed = sentences.where("fixed").join(dated, "payload_id", "left").join(payloads.select("payload_id", "received"), "payload_id").withColumn("observed", F.round(observed, 3))
    readable = placed.groupBy("payload_id").agg(F.bool_and(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("observed").isNotNull()).alias("readable"))
    judged = payloads.select("payload_id", F.trim(F.coalesce("callsign", F.lit(""))).alias("callsign")).join(whole, "payload_id", "left").join(readable, "payload_id", "left")
    reason = first_failure([("callsign", F.col("callsign") == ""), ("checksum", ~F.col("checked")), ("no_positions", F.coalesce("positions", F.lit(0)) == 0), ("no_fix", F.col("readable").isNull()), ("unreadable", ~F.col("readable"))])
    judged = judged.withColumn("reason", reason)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    merged = placed.join(judged.where("reason IS NULL").select("payload_id", "callsign"), "payload_id").groupBy("payload_id", "callsign", "observed").agg(
        *[last(c) for c in ("latitude", "longitude", "speed_kmh", "heading", "altitude_m", "accuracy_m")], F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("sentences"),
    )
    return merged, judged.where("reason IS NOT NULL").select("payload_id", "reason")
