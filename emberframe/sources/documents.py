"""Alerts in XML and features in GeoJSON as rows, by the built-in parsers; what is refused comes beside what is taken.

A payload is a row (payload_id, body). Its alerts or features become rows of their own before they are parsed. Documents that
declare a type or an entity are refused unread.

Defined results. A null or empty body is refused. Of an alert's information blocks the first one in German counts, else the first
in English, else the first. Alerts that aren't live (exercises, tests, drafts), and cancellations without information, are neither taken
nor refused. A feature collection is refused as a whole for one feature without a geometry, for a reference system of its own and where it
isn't JSON; a feature whose coordinates are out of range or too few is refused alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.workspace import first_failure

#: languages of alerts by preference, severities by rank; fixed values
LANGUAGES = ("de", "en")
SEVERITIES = ("Extreme", "Severe", "Moderate", "Minor", "Unknown")
INFO = "language string, category string, event string, urgency string, severity string, certainty string, headline string, description string, effective string, expires string, area array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>"
ALERT = f"identifier string, sender string, sent string, status string, msgType string, scope string, info array<struct<{', '.join(c.replace(' ', ':', 1) for c in INFO.split(', '))}>>"
POINT = "array<struct<x:double,y:double>>"


def declares(body: Column) -> Column:
    """Whether an XML text declares a document type or an entity."""
    return F.upper(body).rlike("<!DOCTYPE|<!ENTITY")


def ring_of(text: Column) -> Column:
    """A closed ring (x, y) of a list of lat,lon pairs; null where a pair can't be read or is out of range."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    points = F.transform(pairs, lambda p: F.struct(F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("x"), F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("y")))
    fine = F.forall(points, lambda p: F.coalesce(p["x"].between(-180, 180) & p["y"].between(-90, 90), F.lit(False)))
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), points).otherwise(F.concat(points, F.array(first)))
    return F.when(fine & (F.size(points) >= 3), closed)


def alerts_of(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, refused with a reason) of XML payloads: an alert by itself or a feed with alerts inside."""
    whole = F.coalesce(F.col("body"), F.lit(""))
    texts = F.regexp_extract_all(whole, F.lit(r"(?s)<(?:\w+:)?alert[\s>].*?</(?:\w+:)?alert>"), F.lit(0))
    empty = payloads.select("payload_id", first_failure([("empty", F.trim(whole) == ""), ("declaration", declares(whole)), ("no_alert", F.size(texts) == 0)]).alias("reason"), texts.alias("texts"))
    read = empty.where("reason IS NULL").select("payload_id", F.posexplode("texts").alias("place", "text"))
    a = F.from_xml("text", ALERT, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    parsed = read.select("payload_id", "place", a.alias("a"))
    # a blank status counts as a live one
    live = F.lower(F.coalesce(F.nullif(F.trim("a.status"), F.lit("")), F.lit("actual"))) == "actual"
    spoken = lambda w: F.get(F.filter("a.info", lambda i: F.lower(F.trim(F.coalesce(i["language"], F.lit("")))).startswith(w)), F.lit(0))
    preferred = F.coalesce(*[spoken(w) for w in LANGUAGES], F.get("a.info", F.lit(0)))
    known = parsed.withColumns({"live": F.col("a").isNull() | live, "i": preferred})
    name = F.trim(F.coalesce("a.identifier", F.lit("")))
    silent = F.lower(F.coalesce("a.msgType", F.lit(""))).isin("cancel", "ack", "error") & F.col("i").isNull()
    polygons = F.flatten(F.transform(F.coalesce("i.area", F.array().cast("array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>")), lambda x: F.coalesce(x["polygon"], F.array().cast("array<string>"))))
    rings = F.transform(polygons, ring_of)
    judged = known.where(F.col("live") & ~((name != "") & silent)).withColumn("rings", rings)
    judged = judged.withColumn("reason", first_failure([("identifier", name == ""), ("no_info", F.col("i").isNull()), ("polygon", F.exists("rings", lambda r: r.isNull()))]))
    clean = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    severity = clean("i.severity", "Unknown")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    taken = judged.where("reason IS NULL").select(
        "payload_id", name.alias("identifier"), F.trim("a.sender").alias("sender"), F.trim("a.sent").alias("sent"), F.trim("i.event").alias("event"), severity.alias("severity"), F.when(rank > 0, rank - 1).otherwise(len(SEVERITIES)).cast("int").alias("severity_rank"),
        clean("i.urgency", "Unknown").alias("urgency"), clean("i.certainty", "Unknown").alias("certainty"), F.trim("i.headline").alias("headline"), F.trim("i.expires").alias("expires"), F.lower(F.trim("i.language")).alias("language"), "rings",
    )
    refused = empty.where("reason IS NOT NULL").select("payload_id", "reason").unionByName(judged.where("reason IS NOT NULL").select("payload_id", "reason"))
    return taken, refused


def features_of(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, refused with a reason) of GeoJSON payloads: place in the payload, geometry type, points (x, y) in order, name, properties as JSON."""
    v = F.try_parse_json("body")
    text = lambda path: F.try_variant_get("v", path, "string")
    held = payloads.select("payload_id", v.alias("v"))
    default = text("$.crs.properties.name") == "urn:ogc:def:crs:OGC:1.3:CRS84"
    many, one = F.try_variant_get("v", "$.features", "array<variant>"), F.array(F.col("v"))
    listed = held.select("payload_id", "v", F.when(text("$.type") == "Feature", one).when(text("$.type") == "FeatureCollection", many).alias("features"), (F.coalesce(text("$.crs"), F.lit("")) != "").alias("crs"), F.coalesce(default, F.lit(False)).alias("default"))
    bare = F.exists("features", lambda f: F.try_variant_get(f, "$.geometry.type", "string").isNull())
    listed = listed.withColumn("reason", first_failure([("not_json", F.col("v").isNull()), ("reference_system", F.col("crs") & ~F.col("default")), ("not_features", F.col("features").isNull()), ("no_geometry", bare)]))
    each = listed.where("reason IS NULL").select("payload_id", F.posexplode("features").alias("place", "f"))
    part = lambda path, kind: F.try_variant_get("f", path, kind)
    kind = part("$.geometry.type", "string")
    pairs = F.when(kind == "Point", F.array(part("$.geometry.coordinates", "array<double>"))).when(kind == "LineString", part("$.geometry.coordinates", "array<array<double>>")).when(kind == "Polygon", part("$.geometry.coordinates[0]", "array<array<double>>"))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    shaped = each.select("payload_id", "place", kind.alias("kind"), points.alias("points"), part("$.properties.name", "string").alias("name"), F.to_json(part("$.properties", "variant")).alias("properties"))
    inside = F.forall("points", lambda p: F.coalesce(p["x"].between(-180, 180) & p["y"].between(-90, 90), F.lit(False)))
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    open_ = (first["x"] != last["x"]) | (first["y"] != last["y"])
    rules = [("geometry_type", ~F.col("kind").isin("Point", "LineString", "Polygon")), ("coordinates", F.col("points").isNull() | ~inside), ("too_few_points", ((F.col("kind") == "LineString") & (F.size("points") < 2)) | ((F.col("kind") == "Polygon") & (F.size("points") < 4))), ("open_ring", (F.col("kind") == "Polygon") & open_)]
    judged = shaped.withColumn("reason", first_failure(rules))
    nothing = F.lit(None).cast("int")
    refused = listed.where("reason IS NOT NULL").select("payload_id", nothing.alias("place"), "reason").unionByName(judged.where("reason IS NOT NULL").select("payload_id", "place", "reason"))
    return judged.where("reason IS NULL").drop("reason"), refused
