"""The incident workspace: events, alerts, features, links, audit, jobs, checks, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of the safety checklist; fixed values
CHECKS = ("hazards", "lookouts", "communications", "escape_routes", "safety_zones", "medical", "alternative_access", "withdrawal_triggers", "weather_update")


def newest(rows: DataFrame, time: str, n: int, key: str = "id", ascending: bool = False) -> DataFrame:
    """The n newest rows, of equally new ones those of the largest keys; ascending hands them out oldest first."""
    top = rows.orderBy(F.desc(time), F.desc(key)).limit(n)
    return top.orderBy(time, key) if ascending else top


def newest_of_each(rows: DataFrame, by: Sequence[str], time: str, n: int, key: str = "id") -> DataFrame:
    """The n newest rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), F.desc(key)))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by order: an upsert of rows that arrive in that order. Partial aggregation keeps a hot key small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def overlaps(west: float, south: float, east: float, north: float) -> Column:
    """Whether a row's bounds (west, south, east, north) meet the box; rows without bounds don't."""
    return F.coalesce((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south), F.lit(False))


def alerts_in_force(alerts: DataFrame, now: int, box: tuple[float, float, float, float] | None = None, severity: str | None = None) -> DataFrame:
    """Alerts that haven't expired, by severity and newest first."""
    found = alerts.where(F.col("expires").isNull() | (F.col("expires") >= now))
    if severity:
        found = found.where(F.col("severity") == severity)
    return (found.where(overlaps(*box)) if box else found).orderBy("severity_rank", F.desc("sent"), "id")


def alert_upsert(records: DataFrame) -> DataFrame:
    """Records of one publisher identifier become one alert: first received, last updated, last content."""
    return records.groupBy("identifier").agg(F.min("received").alias("received_at"), F.max("received").alias("updated_at"), F.max_by("content", F.struct("received", "id")).alias("content"))


def progression(features: DataFrame, start: int, end: int) -> DataFrame:
    """Each feature with whether it was there before start, is there by end, is new between; an unreadable time counts as the earliest."""
    at = F.coalesce("observed", "created", F.lit(-(1 << 62)))
    return features.select("id", (at <= start).alias("before"), (at <= end).alias("after"), ((at > start) & (at <= end)).alias("new"))


def audit_recent(log: DataFrame, types: Sequence[str], since: str, limit: int = 100) -> DataFrame:
    return newest(log.where(F.col("entity_type").isin(*types) & (F.col("changed_at") > since)), "changed_at", max(1, min(1000, limit)))


def purge_jobs(jobs: DataFrame, before: int, keep_last: int = 200) -> DataFrame:
    """Jobs that stay: unfinished, young, or among the newest by id."""
    kept = jobs.orderBy(F.desc("id")).limit(keep_last).select("id")
    gone = jobs.where(F.col("finished").isNotNull() & (F.col("finished") < before)).join(F.broadcast(kept), "id", "left_anti").select("id")  # keep_last rows
    return jobs.join(gone, "id", "left_anti")


def checklist(periods: DataFrame, stored: DataFrame) -> DataFrame:
    """Every period's whole checklist; checks that aren't stored are open."""
    items = F.array(*[F.lit(c) for c in CHECKS])
    return periods.select("period_id", F.explode(items).alias("item")).join(stored, ["period_id", "item"], "left").select("period_id", "item", F.coalesce("checked", F.lit(False)).alias("checked"))


def revise(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Optimistic updates (id, expected, content): applied with the next revision, or a conflict that leaves the row as it is; unknown ids are missing."""
    both = updates.join(current.select("id", F.col("content").alias("old"), "revision"), "id", "left")
    outcome = F.when(F.col("revision").isNull(), "missing").when(F.col("revision") == F.col("expected"), "applied").otherwise("conflict")
    applied = outcome == "applied"
    return both.select("id", outcome.alias("outcome"), F.when(applied, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(applied, F.col("content")).otherwise(F.col("old")).alias("content"))


def soft_delete(features: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Features with those of ids marked inactive, their revision raised; those deleted before stay as they are."""
    hit = features.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & F.col("deleted_at").isNull())
    return hit.select("id", F.when(F.col("hit"), "inactive").otherwise(F.col("status")).alias("status"), F.when(F.col("hit"), F.lit(at)).otherwise(F.col("deleted_at")).alias("deleted_at"), (F.col("revision") + F.col("hit").cast("long")).alias("revision"))


def merge(local: DataFrame, incoming: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows after a merge: incoming wins where it is new or chosen, local elsewhere."""
    both = local.select("id", F.col("content").alias("mine")).join(incoming.select("id", F.col("content").alias("theirs")), "id", "full_outer").join(choices, "id", "left")
    theirs = F.col("mine").isNull() | (F.col("theirs").isNotNull() & (F.coalesce("side", F.lit("local")) == "incoming"))
    return both.select("id", F.when(theirs, F.col("theirs")).otherwise(F.col("mine")).alias("content"), F.when(theirs, "incoming").otherwise("local").alias("taken"))


def staged(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages whose content isn't stored yet, one of each content hash."""
    hashed = packages.withColumn("hash", F.sha2("content", 256))
    return latest_wins(hashed.join(known.select(F.sha2("content", 256).alias("hash")).distinct(), "hash", "left_anti").select("hash", F.col("id"), (-F.col("id")).alias("rank")), ["hash"], ["rank"]).select("hash", "id")


def copied(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with both ends renamed through ids (old, new); ends that aren't copied keep their id."""
    name = lambda end: F.coalesce(F.col(f"{end}_new"), F.col(end)).alias(end)
    of = lambda end: ids.select(F.col("old").alias(end), F.col("new").alias(f"{end}_new"))
    return links.join(of("source"), "source", "left").join(of("target"), "target", "left").select("link_id", name("source"), name("target"))


def double_assignments(assignments: DataFrame) -> DataFrame:
    """Resources with more than one assignment in a period, with a stable warning id."""
    found = assignments.groupBy("period_id", "resource_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("feature_id")), lambda x: x.cast("string"))).alias("features")).where("n > 1")
    return found.withColumn("warning_id", F.substring(F.sha2(F.concat_ws("|", "period_id", "resource_id", "features"), 256), 1, 24))


def crossings(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id) of segments (id, x1, y1, x2, y2) that cross, touch or overlap; met in the grid cells of their boxes, so the join is an equi-join."""
    lattice = lambda p, q: F.sequence(F.floor(F.least(p, q) / cell), F.floor(F.greatest(p, q) / cell))
    met = lambda t, n: t.select(*[F.col(c).alias(f"{n}_{c}") for c in ("id", "x1", "y1", "x2", "y2")], F.explode(lattice("x1", "x2")).alias("cx"), lattice("y1", "y2").alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    turn = lambda p, q, r: (F.col(q[0]) - F.col(p[0])) * (F.col(r[1]) - F.col(p[1])) - (F.col(q[1]) - F.col(p[1])) * (F.col(r[0]) - F.col(p[0]))
    p, q, r, s = ("a_x1", "a_y1"), ("a_x2", "a_y2"), ("b_x1", "b_y1"), ("b_x2", "b_y2")
    apart = lambda i, j: (F.greatest(p[i], q[i]) >= F.least(r[i], s[i])) & (F.greatest(r[j], s[j]) >= F.least(p[j], q[j]))
    hit = apart(0, 0) & apart(1, 1) & (turn(p, q, r) * turn(p, q, s) <= 0) & (turn(r, s, p) * turn(r, s, q) <= 0)
    return met(a, "a").join(met(b, "b"), ["cx", "cy"]).where(hit).select("a_id", "b_id").distinct()


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, or null. A rule whose condition is null isn't broken."""
    found = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        found = F.when(broken, name).otherwise(found)
    return found


def telemetry_rules(future_s: int = 300) -> list[tuple[str, Column]]:
    """Why a report by itself is refused, after what is required and what repeats another one."""
    number = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    return [
        ("observed_at", F.col("observed").isNull()), ("future", F.col("observed") > F.col("received") + future_s), ("position", F.col("latitude").isNull() | F.col("longitude").isNull()),
        ("latitude", F.isnan("latitude") | (F.abs("latitude") > 90)), ("longitude", F.isnan("longitude") | (F.abs("longitude") > 180)), ("not_finite", number("speed") | number("heading") | number("accuracy")),
        ("speed", F.col("speed") < 0), ("accuracy", F.col("accuracy") < 0), ("heading", (F.col("heading") < 0) | (F.col("heading") > 360)),
    ]


def telemetry_rejects(reports: DataFrame, future_s: int = 300) -> DataFrame:
    """Each report with the reason why it is refused (null: taken): external_id and callsign are required; an id that the batch has taken already; then the rules, in order.

    A report that is refused doesn't make a later one with its id a repeat.
    """
    present = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    judged = reports.withColumn("__own", F.when(~(present("external_id") & present("callsign")), "missing_external_id_or_callsign").otherwise(first_failure(telemetry_rules(future_s))))
    before = Window.partitionBy("batch", "external_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.col("__own").isNull().cast("int")).over(before), F.lit(0)) > 0
    reason = F.when(F.col("__own") == "missing_external_id_or_callsign", F.col("__own")).when(taken, "duplicate_in_batch").otherwise(F.col("__own"))
    return judged.select("id", reason.alias("reason"))
