"""Events against brute force: links, components, pieces of bounded span."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from emberframe.operators import clustering, graph

SCHEMA = "id long, latitude double, longitude double, acq_ts long, scan double, track double, source string"
BASE, HOUR = 1_800_000_000, 3600


def frame(spark, rows):
    return spark.createDataFrame([(i, lat, lon, ts, scan, track, "VIIRS") for i, (lat, lon, ts, scan, track) in enumerate(rows)], SCHEMA)


def components_brute(rows, speed, hours, most):
    lat = np.array([r[0] for r in rows])
    lon = np.array([r[1] for r in rows])
    t = np.array([r[2] for r in rows]) / 3600
    half = np.array([math.hypot(r[3] or 0.0, r[4] or 0.0) / 2 for r in rows])
    r = np.where(half > 0, half, 1.0)
    lon0 = math.degrees(math.atan2(np.sin(np.radians(lon)).mean(), np.cos(np.radians(lon)).mean()))
    x = ((lon - lon0 + 180) % 360 - 180) * 111.320 * math.cos(math.radians(lat.mean()))
    y = lat * 110.574
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        apart = np.abs(t - t[i])
        d = np.hypot(x - x[i], y - y[i])
        for j in np.flatnonzero((apart <= hours) & (d <= r + r[i] + speed * apart) & (d <= most)).tolist():
            a, b = top(i), top(j)
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(rows))]


def events(found):
    return [r.event for r in sorted(found.collect(), key=lambda r: r.id)]


def span(rows, members):
    lon = np.array([rows[i][1] for i in members])
    lon = lon[0] + (lon - lon[0] + 180) % 360 - 180
    lat = np.array([rows[i][0] for i in members])
    a = math.sin(math.radians(lat.max() - lat.min()) / 2) ** 2 + math.cos(math.radians(lat.min())) * math.cos(math.radians(lat.max())) * math.sin(math.radians(lon.max() - lon.min()) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(a))


@pytest.mark.parametrize("few", [(1 << 20, 4096), (30, 12)])
def test_components_against_brute_force(spark, monkeypatch, few):
    """With cells compared at once, and with cells that are halved."""
    monkeypatch.setattr(clustering, "FEW_PAIRS", few[0])
    monkeypatch.setattr(clustering, "FEW_ROWS", few[1])
    rng = np.random.default_rng(4)
    rows = []
    for lat, lon in ((50, 4), (50.3, 4.2), (-16, 10), (50, 5.6)):
        n = 60
        rows += [(lat + float(rng.normal(0, 0.05)), lon + float(rng.normal(0, 0.05)), BASE + int(rng.integers(200 * HOUR)), *((0.4, 0.5) if i % 3 else (None, None))) for i in range(n)]
    rows += rows[:10]
    for speed, hours, most in ((0.2, 24.0, 100.0), (2.0, 6.0, 5.0)):
        assert events(clustering.labelled(frame(spark, rows), speed, hours, most)) == components_brute(rows, speed, hours, most)


def test_crowded_cell(spark):
    """30,000 detections in one cell of space and time, and two far from it."""
    rng = np.random.default_rng(5)
    rows = [(40 + float(a), 10 + float(b), BASE + int(c), 0.4, 0.4) for a, b, c in zip(rng.random(30_000) * 0.2, rng.random(30_000) * 0.2, rng.integers(5 * HOUR, size=30_000), strict=True)]
    rows += [(45.0, 10.0, BASE, 0.4, 0.4), (45.0, 10.001, BASE, 0.4, 0.4)]
    found = events(clustering.labelled(frame(spark, rows), 1.0, 6.0, 100.0))
    assert set(found[:-2]) == {0}
    assert found[-2:] == [30_000, 30_000]


def test_chain_is_span_bounded(spark):
    """1,017 km of steps that each link: pieces within the bound, none of one detection, every detection in one."""
    rows = [(50.0, 4.0 + step * 0.25, BASE + step * 3 * HOUR, 0.4, 0.4) for step in range(58)]
    whole = frame(spark, rows)
    assert set(events(clustering.labelled(whole))) == {0}
    assert span(rows, range(58)) > 1000
    found = events(clustering.span_bounded(whole))
    pieces = {e: [i for i, x in enumerate(found) if x == e] for e in set(found)}
    assert len(pieces) > 1
    assert all(len(p) > 1 and min(p) == e and span(rows, p) <= 100 for e, p in pieces.items())
    told = clustering.described(whole, clustering.span_bounded(whole)).collect()
    assert {r.event: r.n for r in told} == {e: len(p) for e, p in pieces.items()}
    assert not any(r.wide_span for r in told)


def test_fire_across_the_antimeridian_is_one(spark):
    rows = [(-16.5, lon, BASE + i * 1800, 0.4, 0.4) for i, lon in enumerate([179.96, 179.98, -180.0, -179.98, -179.96])]
    found = clustering.span_bounded(frame(spark, rows))
    assert set(events(found)) == {0}
    (told,) = clustering.described(frame(spark, rows), found).collect()
    assert told.west == pytest.approx(179.96) and told.east == pytest.approx(-179.96)
    assert told.span_km < 30 and abs(abs(told.centroid_lon) - 180) < 0.01


def test_twenty_days_apart_and_missing_values(spark):
    rows = [(50.0, 4.0, BASE, 0.4, 0.4), (50.0, 4.0, BASE + 20 * 24 * HOUR, 0.4, 0.4), (50.0005, 4.0005, BASE + HOUR, None, None), (None, 4.0, BASE, 0.4, 0.4), (50.0, None, BASE, 0.4, 0.4), (50.0, 4.0, None, 0.4, 0.4)]
    found = {r.id: r.event for r in clustering.span_bounded(frame(spark, rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 0}
    assert clustering.span_bounded(frame(spark, rows).limit(0)).collect() == []


def test_components_of_many_tasks(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(400, size=(300, 2))] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(50)]
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        label[max(p, q)] = min(p, q)
    want = {x: top(x) for x in label}
    df = spark.createDataFrame(edges, "a long, b long")
    for in_task in (1_000_000, 60):
        found = {r.id: r.component for r in graph.components(df, in_task).collect()}
        assert found == {x: want[x] for x in found}
        assert set(want) - set(found) <= {x for x in want if want[x] == x}


def test_components_store_a_few_times_the_edges(spark, monkeypatch):
    """Ids of components that are whole, and those that moved, take no part in later rounds."""
    ids = list(range(4000))
    random.Random(5).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(3999) if i % 200 != 199]
    rows, own = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (t := own(df), rows.append(t.count()))[0])
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), 200).collect()}
    least = {i: min(ids[n // 200 * 200 : n // 200 * 200 + 200]) for n, i in enumerate(ids)}
    assert found == least
    assert sum(rows) < 12 * len(edges), rows
