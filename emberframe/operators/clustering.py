"""Fire events: detections linked in space and time, their components, and pieces of bounded span.

Two detections are linked where their distance is no more than both radii and what speed_kmh makes of the hours between them, at
most `hours` and at most `most_km` apart. Components need links that connect, not all of them, so tasks hand on a forest. Cells
as wide as a link may be meet their neighbours; two cells of few detections are compared exhaustively. A pair of crowded cells is parted
into halves of space and time: halves all of whose detections are linked by their bounds are joined without looking
at them, halves too far apart are dropped, and halves that are in one component already aren't compared.

A component whose box has a diagonal above the bound is halved at the middle of its longer projected side, again and again.
Longitudes are unwrapped around the circular mean, of all detections for links and of each piece for its span.

Defined results. Rows without a position or a time take no part. An empty table gives no rows. Distances are projected at the
mean latitude; the diagonal is a great circle's. Radii come from scan and track, 1 km where both are missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geo import LATITUDE_KM, LONGITUDE_KM, footprint_km, haversine_km, unwrapped
from emberframe.operators.graph import beside, components, forest
from emberframe.session import cut, shuffle_partitions

SPEED_KMH, HOURS, MOST_KM = 8.0, 168.0, 100.0
FEW_PAIRS, FEW_ROWS = 1 << 20, 4096  #: of two cells that are compared exhaustively
DEPTH = 16  #: halvings of cells; then any two are compared
SPLITS = 20  #: halvings of a component
HALF = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]  # of two neighbouring cells one is named first
CELL = ("cx", "cy", "ct")


def circular_mean(degrees: Column) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def near_turn(lon: Column, reference: Column) -> Column:
    """The same longitude within half a turn of the reference; one that is there already is left as it is, to the last digit."""
    return lon + 360 * F.floor((reference - lon + 180) / 360)


def placed(detections: DataFrame) -> tuple[DataFrame, float]:
    """(id, x, y, t, r, latitude, longitude): km around the mean position, seconds, radius; and the largest radius."""
    known = detections.where("id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND acq_ts IS NOT NULL")
    radius = footprint_km(F.col("scan"), F.col("track"))
    mean = known.agg(F.avg("latitude").alias("lat"), circular_mean(F.col("longitude")).alias("lon"), F.max(radius).alias("r")).first()
    lat, lon = mean["lat"] or 0.0, mean["lon"] or 0.0
    x = (unwrapped(F.col("longitude"), F.lit(lon)) - lon) * (LONGITUDE_KM * math.cos(math.radians(lat)))
    return known.select("id", x.alias("x"), ((F.col("latitude") - lat) * LATITUDE_KM).alias("y"), F.col("acq_ts").alias("t"), radius.alias("r"), "latitude", "longitude"), mean["r"] or 0.0


def _rule(a: dict, b: dict, speed: float, hours: float, most: float) -> np.ndarray:
    apart = np.abs(a["t"] - b["t"]) / 3600
    distance = np.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return (apart <= hours) & (distance <= a["r"] + b["r"] + speed * apart) & (distance <= most)


def _compared(batches: Iterator[pa.RecordBatch], speed: float, hours: float, most: float) -> Iterator[pa.RecordBatch]:
    """Forests of the links within cell pairs, from rows (pair, side, id, x, y, t, r) in the order of pair. Side 2 meets all, 0 meets 1."""
    names = ("pair", "side", "id", "x", "y", "t", "r")
    rest: dict[str, np.ndarray] = {}

    def links(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        pair = rows["pair"]
        if not len(pair):
            return
        begin = np.flatnonzero(np.diff(pair, prepend=pair[0] - 1))
        sizes = np.diff(np.append(begin, len(pair)))
        place, size = np.arange(len(pair)) - np.repeat(begin, sizes), np.repeat(sizes, sizes)
        ids, of = np.unique(rows["id"], return_inverse=True)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def test(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal found, held
            meet = (rows["side"][i] == 2) | (rows["side"][i] != rows["side"][j])
            i, j = i[meet], j[meet]
            fine = _rule({k: rows[k][i] for k in "xytr"}, {k: rows[k][j] for k in "xytr"}, speed, hours, most)
            found.append((of[i[fine]], of[j[fine]]))
            held += int(fine.sum())
            if held > 1 << 20:
                found = [forest(len(ids), *(np.concatenate(p) for p in zip(*found, strict=True)))]
                held = len(found[0][0])

        open_ = np.flatnonzero(size <= 64)  # small ones all at once, by their distance in the order
        for shift in range(1, 64):
            open_ = open_[place[open_] + shift < size[open_]]
            if len(open_):
                test(open_, open_ + shift)
        for at, n in zip(begin[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            for i in range(at, at + n - 1, step := max(1, (1 << 19) // n)):
                left = np.arange(i, min(i + step, at + n))
                right = np.arange(i, at + n)
                p, q = (z.ravel() for z in np.meshgrid(left, right, indexing="ij"))
                test(p[p < q], q[p < q])
        moved, least = forest(len(ids), *(np.concatenate(p) for p in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least])], names=["a", "b"])

    for batch in batches:
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if rest:
            now = {n: np.concatenate([rest[n], now[n]]) for n in names}
        last = np.flatnonzero(np.diff(now["pair"]))
        to = int(last[-1]) + 1 if len(last) else 0
        yield from links({n: v[:to] for n, v in now.items()})
        rest = {n: v[to:] for n, v in now.items()}
    if rest:
        yield from links(rest)


def _celled(points: DataFrame, side: float, hours: float, level: int) -> DataFrame:
    """points with the cell of this level: each level halves the sides and the hours."""
    scale = 2.0**level
    cells = (F.floor(F.col("x") / (side / scale)), F.floor(F.col("y") / (side / scale)), F.floor(F.col("t") / (hours * 3600 / scale)))
    return points.withColumns(dict(zip(CELL, cells, strict=True)))


def _nodes(celled: DataFrame) -> DataFrame:
    bounds = [f(c).alias(f"{n}_{c}") for c in "xytr" for n, f in (("min", F.min), ("max", F.max))]
    return celled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), *bounds)


def _of(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns])


def _bounded(pairs: DataFrame, speed: float, hours: float, most: float) -> DataFrame:
    """pairs with `none` (no two of their detections can be linked) and `sure` (any two are), by the cells' bounds."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_min_{c}") - F.col(f"b_max_{c}"), F.col(f"b_min_{c}") - F.col(f"a_max_{c}"))
    width = lambda c: F.greatest(F.col(f"a_max_{c}") - F.col(f"b_min_{c}"), F.col(f"b_max_{c}") - F.col(f"a_min_{c}"))
    near, far = F.hypot(gap("x"), gap("y")), F.hypot(width("x"), width("y"))
    soon, late = gap("t") / 3600, width("t") / 3600
    margin = 1e-9  # a bound within rounding of the rule decides nothing
    none = (soon > hours) | (near > F.col("a_max_r") + F.col("b_max_r") + speed * F.least(late, F.lit(hours)) + margin) | (near > most + margin)
    sure = (late <= hours) & (far + margin <= F.col("a_min_r") + F.col("b_min_r") + speed * soon) & (far + margin <= most)
    return pairs.withColumns({"none": none, "sure": sure, "same": (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & (F.col("a_ct") == F.col("b_ct"))})


def _exhaustive(celled: DataFrame, pairs: DataFrame, speed: float, hours: float, most: float) -> DataFrame:
    """a, b: forests of the links within these pairs of cells."""
    sides = []
    for side, which, number in (("a", "same", 2), ("a", "NOT same", 0), ("b", "NOT same", 1)):
        own = pairs.where(which).select(F.xxhash64(*[f"{s}_{c}" for s in "ab" for c in CELL]).alias("pair"), *[F.col(f"{side}_{c}").alias(c) for c in CELL])
        sides.append(celled.join(own, list(CELL)).select("pair", F.lit(number).alias("side"), "id", "x", "y", "t", "r"))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    dealt = rows.repartition(shuffle_partitions(celled.sparkSession), "pair").sortWithinPartitions("pair")
    return cut(dealt.mapInArrow(partial(_compared, speed=speed, hours=hours, most=most), "a long, b long"))


def links(points: DataFrame, radius: float, speed: float, hours: float, most: float) -> DataFrame:
    """a, b: links and their like that connect what the rule connects. points: (id, x, y, t, r)."""
    side = min(2 * radius + speed * hours, most)
    few = (F.col("a_n") * F.col("b_n") <= FEW_PAIRS) & (F.col("a_n") + F.col("b_n") <= FEW_ROWS)
    celled = _celled(points, side, hours, 0)
    nodes = cut(_nodes(celled))
    if nodes.isEmpty():
        return points.sparkSession.createDataFrame([], "a long, b long")
    offsets = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(CELL, o, strict=True)]) for o in HALF])
    met = _of(nodes, "a").withColumn("o", F.explode(offsets)).withColumns({f"b_{c}": F.col(f"a_{c}") + F.col(f"o.{c}") for c in CELL}).drop("o")
    pairs = cut(_bounded(met.join(_of(nodes, "b"), [f"b_{c}" for c in CELL]), speed, hours, most).where("NOT none"))
    edges = _exhaustive(celled, pairs.where(few & ~F.col("sure")), speed, hours, most)
    for level in range(1, DEPTH + 1):
        sure = pairs.where("sure")
        whole = sure.select(*[F.col(f"a_{c}").alias(c) for c in CELL], F.col("a_least").alias("least")).union(sure.select(*[f"b_{c}" for c in CELL], "b_least")).distinct()
        if not sure.isEmpty():
            joined = celled.join(whole, list(CELL)).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
            edges = cut(edges.unionByName(joined).unionByName(sure.where("NOT same").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))))
        crowded = cut(pairs.where(~few & ~F.col("sure")).select(*[f"{s}_{c}" for s in "ab" for c in CELL], "same"))
        if crowded.isEmpty():
            return edges
        # halves of crowded cells: those of a pair meet, named in one order where they come from one cell
        both = crowded.select(*[F.col(f"a_{c}").alias(c) for c in CELL]).union(crowded.select(*[f"b_{c}" for c in CELL])).distinct()
        points = celled.join(both, list(CELL), "left_semi").drop(*CELL)
        celled = cut(_celled(points, side, hours, level))
        nodes = cut(_nodes(celled))
        up = lambda s: [(F.floor(F.col(f"{s}_{c}") / 2)).alias(f"up_{s}_{c}") for c in CELL]
        a, b = (_of(nodes, s).select("*", *up(s)) for s in "ab")
        above = crowded.select(*[F.col(f"{s}_{c}").alias(f"up_{s}_{c}") for s in "ab" for c in CELL], F.col("same").alias("from_same"))
        met = above.join(a, [f"up_a_{c}" for c in CELL]).join(b, [f"up_b_{c}" for c in CELL])
        order = lambda s: F.struct(*[f"{s}_{c}" for c in CELL])
        met = met.where(~F.col("from_same") | (order("a") <= order("b"))).drop("from_same", *[f"up_{s}_{c}" for s in "ab" for c in CELL])
        pairs = cut(_bounded(met, speed, hours, most).where("NOT none"))
        small = few | F.lit(level == DEPTH)
        # what lies in one cell first; then pairs of cells that aren't in one component already
        edges = cut(edges.unionByName(_exhaustive(celled, pairs.where(small & F.col("same") & ~F.col("sure")), speed, hours, most)))
        labels = components(edges.unionByName(pairs.where("sure AND NOT same").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))))
        named = celled.join(labels, "id", "left").groupBy(*CELL).agg(F.min(F.coalesce("component", "id")).alias("low"), F.max(F.coalesce("component", "id")).alias("high")).where("low = high").drop("high")
        one = lambda s: named.select(*[F.col(c).alias(f"{s}_{c}") for c in CELL], F.col("low").alias(f"{s}_whole"))
        known = pairs.join(one("a"), [f"a_{c}" for c in CELL], "left").join(one("b"), [f"b_{c}" for c in CELL], "left")
        pairs = cut(known.where("sure OR a_whole IS NULL OR b_whole IS NULL OR a_whole <> b_whole").drop("a_whole", "b_whole"))
        edges = cut(edges.unionByName(_exhaustive(celled, pairs.where(small & ~F.col("same") & ~F.col("sure")), speed, hours, most)))
        if level == DEPTH:
            pairs = pairs.where("sure")
    return edges


def labelled(detections: DataFrame, speed_kmh: float = SPEED_KMH, hours: float = HOURS, most_km: float = MOST_KM) -> DataFrame:
    """id, event (the smallest id of its component) of every detection that has a position and a time."""
    points, radius = placed(detections)
    labels = components(links(points, radius, speed_kmh, hours, most_km))
    return points.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("event"))


def split(points: DataFrame, span_km: float, depth: int = SPLITS) -> DataFrame:
    """id, event (the smallest id of the piece), pieces of points (id, event, latitude, longitude) whose box has a diagonal of at most span_km.

    Each round looks at the pieces that are still too wide, by partial sums per piece; a piece of a third of all rows is one row of a broadcast.
    """
    left, done, total = cut(points.select("id", F.struct(F.col("event"), F.lit(1).cast("long").alias("path")).alias("piece"), "latitude", "longitude")), None, points.count()
    for level in range(depth + 1):
        mean = left.groupBy("piece").agg(F.avg("latitude").alias("lat0"), circular_mean(F.col("longitude")).alias("lon0"), F.count(F.lit(1)).alias("rows"))
        turned = beside(left, cut(mean), "piece", "rows", total).withColumn("x", near_turn(F.col("longitude"), F.col("lon0")))
        boxes = cut(turned.groupBy("piece").agg(F.first("lat0").alias("lat0"), F.first("rows").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in ("latitude", "x") for n, f in (("min", F.min), ("max", F.max))]))
        wide = haversine_km(F.col("min_latitude"), F.col("min_x"), F.col("max_latitude"), F.col("max_x")) > span_km
        boxes = boxes.select("piece", F.col("rows").alias("members"), (wide & F.lit(level < depth)).alias("wide"),
            ((F.col("max_x") - F.col("min_x")) * LONGITUDE_KM * F.cos(F.radians("lat0")) >= (F.col("max_latitude") - F.col("min_latitude")) * LATITUDE_KM).alias("along_x"),
            ((F.col("min_x") + F.col("max_x")) / 2).alias("middle_x"), ((F.col("min_latitude") + F.col("max_latitude")) / 2).alias("middle_y"))
        judged = cut(beside(turned.select("id", "piece", "latitude", "longitude", "x"), boxes, "piece", "members", total))
        closed = judged.where("NOT wide").select("id", "piece")
        done = closed if done is None else done.unionByName(closed)
        second = F.when(F.col("along_x"), F.col("x") >= F.col("middle_x")).otherwise(F.col("latitude") >= F.col("middle_y"))
        left = judged.where("wide").select("id", F.struct(F.col("piece.event"), (F.col("piece.path") * 2 + second.cast("long")).alias("path")).alias("piece"), "latitude", "longitude")
        if left.isEmpty():
            break
    names = done.groupBy("piece").agg(F.min("id").alias("event"), F.count(F.lit(1)).alias("members"))
    return beside(done, names, "piece", "members", total).select("id", "event")


def span_bounded(detections: DataFrame, speed_kmh: float = SPEED_KMH, hours: float = HOURS, span_km: float = MOST_KM) -> DataFrame:
    """id, event: components by the rule, none wider than span_km (a link isn't either)."""
    whole = labelled(detections, speed_kmh, hours, span_km)
    return split(detections.select("id", "latitude", "longitude").join(whole, "id"), span_km)


def described(detections: DataFrame, labels: DataFrame, span_km: float = MOST_KM, least: int = 2) -> DataFrame:
    """A row per event of at least so many detections: box, centroid, times, sources, diagonal, whether that is beyond the bound. A box across 180 degrees has west > east."""
    known = detections.join(labels, "id")
    mean = known.groupBy("event").agg(circular_mean(F.col("longitude")).alias("lon0"), F.count(F.lit(1)).alias("rows"))
    turned = beside(known, cut(mean), "event", "rows", known.count()).withColumn("x", near_turn(F.col("longitude"), F.col("lon0")))
    around = lambda c: near_turn(c, F.lit(0.0))
    whole = turned.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.min("acq_ts").alias("first_seen"), F.max("acq_ts").alias("last_seen"), F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("latitude").alias("centroid_lat"), F.avg("x").alias("centroid_x"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"),
    )
    span = haversine_km(F.col("south"), F.col("x0"), F.col("north"), F.col("x1"))
    return whole.where(F.col("n") >= least).select("event", "n", "first_seen", "last_seen", around(F.col("x0")).alias("west"), "south", around(F.col("x1")).alias("east"), "north", "centroid_lat", around(F.col("centroid_x")).alias("centroid_lon"), "sources", span.alias("span_km"), (span > span_km).alias("wide_span"))
