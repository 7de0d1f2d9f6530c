"""Position reports as a stream: validation, replay by external id, quality flags and the newest position, kept as state.

Reports are grouped by their source. A source's state is a map of the external ids it has used, with a digest of what they
said, and a map of the newest position of each callsign; both are looked up by key, so a batch costs what its own reports
cost, however long the history. Lateness is a flag and never drops a row, so no watermark is set. Ids that haven't been seen
again for `remember` days leave the state by their time to live.

One stream of rows comes out, taken and refused reports alike, and is written by the file sink, whose log of batches makes each
batch's files visible at once: after a failure a batch is there whole or not at all.

Defined results. A report is refused for the first rule that it breaks (operators.workspace.telemetry_rules), for missing external_id or
callsign, for an id that its batch has taken already, or for an id that was used with other content. The same report again is a replay: it comes out with
the reason "replayed" and changes nothing. Within a batch a source's reports count in the order of their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberframe.operators.incidents import covering
from emberframe.operators.workspace import first_failure, telemetry_rules

LATE_S, FUTURE_S, POOR_M, FAST_KMH = 300, 300, 100.0, 180.0
EARTH_KM = 6371.0088
REMEMBER_DAYS = 30  #: how long an external id is remembered after it was last used
REPORT = "id long, external_id string, callsign string, unit long, observed long, received long, latitude double, longitude double, speed double, accuracy double, heading double"
FLAGS = "late boolean, out_of_order boolean, poor_accuracy boolean, implausible_speed boolean, derived_speed_kmh double, newest boolean"
JUDGED = f"{REPORT}, reason string, {FLAGS}"
CONTENT = ("external_id", "callsign", "observed", "latitude", "longitude", "speed", "accuracy", "heading")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return float(2 * EARTH_KM * np.arcsin(min(1.0, np.sqrt(a))))


class Judge(StatefulProcessor):
    """Takes or refuses the reports of one source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "external_id string", "digest string", REMEMBER_DAYS * 86_400_000)
        self.newest = handle.getMapState("newest", "callsign string", "observed long, latitude double, longitude double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a batch's reports of one source come together, so that their order by id is the order of arrival
        reports = pd.concat(list(rows)).sort_values("id", kind="stable")
        known: dict[str, tuple] = {}  # newest positions that this batch has read or moved
        fresh: dict[str, str] = {}
        out = []
        for r in reports.to_dict("records"):
            external, callsign = r["external_id"], r["callsign"]
            flags = dict.fromkeys(("late", "out_of_order", "poor_accuracy", "implausible_speed", "newest"), None) | {"derived_speed_kmh": None}
            reason = r["reason"] if isinstance(r["reason"], str) else None
            digest = hashlib.sha256(repr([None if pd.isna(r[c]) else r[c] for c in CONTENT]).encode()).hexdigest()
            if reason != "missing_external_id_or_callsign" and external in fresh:
                reason = "duplicate_in_batch"
            if reason is None and self.seen.containsKey((external,)):
                reason = "replayed" if self.seen.getValue((external,))[0] == digest else "conflict"
            if reason is None:
                fresh[external] = digest
                self.seen.updateValue((external,), (digest,))
                if callsign not in known:
                    known[callsign] = self.newest.getValue((callsign,)) if self.newest.containsKey((callsign,)) else None
                last, at = known[callsign], int(r["observed"])
                flags |= {"late": r["received"] - at > LATE_S, "out_of_order": last is not None and at < last[0], "poor_accuracy": bool(r["accuracy"] > POOR_M), "implausible_speed": False, "newest": last is None or at >= last[0]}
                if last is not None and at > last[0]:
                    speed = km_between(last[1], last[2], r["latitude"], r["longitude"]) / ((at - last[0]) / 3600)
                    flags |= {"derived_speed_kmh": round(speed, 3), "implausible_speed": speed > FAST_KMH}
                if flags["newest"]:
                    known[callsign] = (at, float(r["latitude"]), float(r["longitude"]))
            out.append({**r, "reason": reason, **flags})
        for callsign, position in known.items():
            if position is not None:
                self.newest.updateValue((callsign,), position)
        names = [x.split()[0] for x in JUDGED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: object for n in ("late", "out_of_order", "poor_accuracy", "implausible_speed", "newest")})

    def close(self) -> None:
        pass


def judged(reports: DataFrame) -> DataFrame:
    """A stream of REPORT rows as a stream of JUDGED rows: refused ones have a reason, taken ones flags."""
    present = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    first = F.when(~(present("external_id") & present("callsign")), "missing_external_id_or_callsign").otherwise(first_failure(telemetry_rules(FUTURE_S)))
    own = reports.withColumns({"external_id": F.substring(F.trim("external_id"), 1, 200), "callsign": F.substring(F.trim("callsign"), 1, 200)}).withColumn("reason", first)
    return own.groupBy("unit").transformWithStateInPandas(Judge(), JUDGED, "Append", "ProcessingTime")


def start(reports: DataFrame, folder: str) -> StreamingQuery:
    """Judges a stream of REPORT rows until what is there has been read; the rows go to folder/reports."""
    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a time to live alone would ask for batches without end
    out = judged(reports).writeStream.format("parquet").option("path", f"{folder}/reports").option("checkpointLocation", f"{folder}/progress")
    return out.outputMode("append").trigger(availableNow=True).start()


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """The reports taken so far, as the file sink's log has them."""
    return spark.read.schema(JUDGED).parquet(f"{folder}/reports").where("reason IS NULL")


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """The reports refused so far, replays apart."""
    return spark.read.schema(JUDGED).parquet(f"{folder}/reports").where("reason <> 'replayed'")


def latest(spark: SparkSession, folder: str, now: Column | None = None, stale_s: int = 300) -> DataFrame:
    """The newest position of each callsign of a source; with now (epoch seconds) also whether it is stale. Only reports that were the newest when they came are read."""
    best = F.max(F.struct("observed", "id", "latitude", "longitude")).alias("n")
    found = taken(spark, folder).where("newest").groupBy("unit", "callsign").agg(best).select("unit", "callsign", "n.*")
    return found if now is None else found.withColumn("stale", now - F.col("observed") > stale_s)


def hazard_warnings(reports: DataFrame, areas: DataFrame) -> DataFrame:
    """id, callsign, incident_id of taken reports that were their callsign's newest and lie inside a hazard area (incident_id, ring)."""
    newest = reports.where("reason IS NULL AND newest")
    return covering(newest, areas).select("id", "callsign", "incident_id")
