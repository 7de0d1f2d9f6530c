"""Swaths, rasters and contours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from emberframe.operators import contours, rasters, swaths

TRACK = "satellite string, ts long, lat double, lon double, half_width_km double"
GRID = "grid_id long, west double, south double, east double, north double, nx long, ny long"


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_cells_of_a_track_along_the_equator(spark):
    tracks = spark.createDataFrame([("N", 1000, 0.0, 0.0, 600.0), ("N", 1060, 0.0, 5.0, 600.0), ("N", 1120, 0.0, 10.0, 600.0), ("N", 1180, None, 3.0, 600.0)], TRACK)
    found = {(r.cell_x, r.cell_y): (r.pass_count, r.first_ts, r.last_ts) for r in swaths.covered_cells(tracks, 10.0).collect()}
    assert {(17, 8), (18, 9)} <= set(found) and (35, 0) not in found
    want = {}
    for ts, lon in ((1000, 0.0), (1060, 5.0), (1120, 10.0)):
        for x in range(36):
            for y in range(18):
                pad = 600 / 111.32
                inside = (lon - pad + 180) // 10 <= x <= (lon + pad + 180 - 1e-9) // 10 and (90 - pad) // 10 <= y <= (90 + pad - 1e-9) // 10
                if inside and km(0.0, lon, y * 10 - 85.0, x * 10 - 175.0) <= 600 + 556.6:
                    n, a, b = want.get((x, y), (0, ts, ts))
                    want[x, y] = (n + 1, min(a, ts), max(b, ts))
    assert found == want


def test_passes_are_collapsed_and_met_across_the_antimeridian(spark):
    rows = [("N", 60 * i, -60.0 + i, 179.0 if i % 2 else -179.0, 1165.0) for i in range(140)] + [("T", 86_400 - 60 + 60 * i, 70.0, 0.0, 1165.0) for i in range(3)]
    areas = [(1, 179.5, 9.0, 180.5, 11.0), (2, -100.0, 0.0, -99.0, 1.0), (3, 5.0, 78.0, 6.0, 80.0), (4, -179.9, 64.0, -179.7, 66.0)]
    tracks = spark.createDataFrame(rows, TRACK)
    boxes = spark.createDataFrame(areas, "area_id long, west double, south double, east double, north double")
    want = []
    for area, w, s, e, n in areas:
        for sat in ("N", "T"):
            seen = [r[1] for r in rows if r[0] == sat and km(r[2], r[3], (s + n) / 2, (w + e) / 2) <= r[4]]
            runs = []
            for ts in sorted(seen):
                if runs and ts - runs[-1][-1] <= 120 and ts // 86_400 == runs[-1][-1] // 86_400:
                    runs[-1].append(ts)
                else:
                    runs.append([ts])
            want += [(area, sat, run[len(run) // 2]) for run in runs]
    found = sorted(tuple(r) for r in swaths.passes(tracks, boxes).collect())
    assert found == sorted(want) and {a for a, _, _ in found} == {1, 3, 4}
    hits = spark.createDataFrame([(1, want[0][2] + 1800), (3, -99)], "area_id long, acq_ts long")
    assert sorted(tuple(r) for r in swaths.clear_passes(tracks, boxes, hits).collect()) == sorted(w for w in want if w != want[0])


def test_areas_around_one_point_are_swept_once(spark, monkeypatch):
    tracks = spark.createDataFrame([("N", 60 * i, 10.0, 20.0 + i, 600.0) for i in range(4)], TRACK)
    boxes = [(i, 19.9, 9.9, 20.1, 10.1, "a" if i % 2 else None) for i in range(50)] + [(50, 19.9, -40.0, 20.1, -39.0, "a")]
    areas = spark.createDataFrame(boxes, "area_id long, west double, south double, east double, north double, unit string")
    met, plain = [], swaths.in_swath

    def counted(*of):
        found = plain(*of)
        met.append(found.count())
        return found

    monkeypatch.setattr(swaths, "in_swath", counted)
    assert sorted(tuple(r) for r in swaths.passes(tracks, areas).collect()) == [(i, "N", 120) for i in range(50)]
    hits = spark.createDataFrame([("a", 130), ("a", 130), (None, 120)], "unit string, acq_ts long")
    assert sorted(r.area_id for r in swaths.clear_passes(tracks, areas, hits, by="unit").collect()) == list(range(0, 50, 2))
    assert met == [4, 4]


def grid_of(spark, value, west=10.0, south=36.0, step=0.5):
    ny, nx = value.shape
    grids = spark.createDataFrame([(1, west, south, west + nx * step, south + ny * step, nx, ny)], GRID)
    cells = [(1, r, c, float(value[r, c])) for r in range(ny) for c in range(nx) if not np.isnan(value[r, c])]
    return grids, spark.createDataFrame(cells, "grid_id long, row long, col long, value double")


@pytest.mark.parametrize("origin", ["north", "south"])
def test_sampling(spark, origin):
    rng = np.random.default_rng(1)
    value = np.where(rng.random((70, 130)) < 0.2, np.nan, rng.random((70, 130)))
    grids, cells = grid_of(spark, value)
    points = [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(9, 77, 200), rng.uniform(35, 73, 200), strict=True))] + [(900, 1, 10.0, 71.0), (901, 1, 75.0, 36.0), (902, 2, 20.0, 40.0), (903, 1, None, 40.0)]
    found = {r.point_id: r.v for r in rasters.sampled(spark.createDataFrame(points, "point_id long, grid_id long, lon double, lat double"), grids, {"v": rasters.blocks(cells)}, origin).collect()}
    assert len(found) == len(points)
    for i, grid, lon, lat in points:
        want = None
        if grid == 1 and lon is not None and 10 <= lon <= 75 and 36 <= lat <= 71:
            col = min(129, int((lon - 10) / 65 * 130))
            row = min(69, int((71 - lat if origin == "north" else lat - 36) / 35 * 70))
            want = None if np.isnan(value[row, col]) else value[row, col]
        assert found[i] == want


def test_exposure_by_the_nearest_corner_and_triggers_in_order(spark):
    value = np.full((10, 10), np.nan)
    value[5, 5], value[5, 6], value[0, 0] = 8.0, 3.126, float("inf")
    grids, cells = grid_of(spark, value, step=1.0)
    hours = rasters.blocks(cells)
    ring = [(15.5, 40.5), (16.5, 40.5), (16.5, 40.2), (15.5, 40.2), (15.5, 40.5)]
    shapes = spark.createDataFrame([(1, 1, 15.5, 40.5, ring), (2, 1, 15.5, 40.5, None), (3, 1, 12.5, 40.5, None), (4, 1, 0.0, 0.0, [(15.5, 40.5)])], "structure_id long, grid_id long, lon double, lat double, ring array<struct<x:double,y:double>>")
    assert {r.structure_id: r.hours for r in rasters.exposure(shapes, grids, hours).collect()} == {1: 3.126, 2: 8.0, 3: None, 4: 8.0}
    points = spark.createDataFrame([(1, 1, 12.5, 40.5), (2, 1, 15.5, 40.5), (3, 1, 16.5, 40.5), (4, 1, 10.5, 45.5)], "point_id long, grid_id long, lon double, lat double")
    found = rasters.trigger_points(points, grids, {"earliest": hours, "median": hours}).orderBy(rasters.F.col("soonest").asc_nulls_last(), "point_id").collect()
    assert [(r.point_id, r.soonest) for r in found] == [(3, 3.13), (2, 8.0), (1, None), (4, None)]
    assert [(r.point_id, r.severity) for r in rasters.arrival_warnings(points, grids, {"earliest": hours}, 4.0).collect()] == [(3, "elevated")]


def test_slope_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    value = rng.random((130, 71)) * 100
    value[3:9, 60:70] = np.nan
    value[64:, 64:] = np.nan  # a block without a known cell
    grids, cells = grid_of(spark, value)
    found = rasters.cells_of(rasters.slope_aspect(rasters.blocks(cells), grids, 30.0), grids, "slope", "aspect").toPandas()
    filled = np.where(np.isnan(value), np.nanmean(value), value)
    dy, dx = np.gradient(filled, 30.0)
    slope, aspect = np.arctan(np.hypot(dx, dy)), np.degrees(np.arctan2(-dx, dy)) % 360
    assert len(found) == value.size
    for name, want in (("slope", slope), ("aspect", aspect)):
        got = np.zeros(value.shape)
        got[found["row"], found["col"]] = found[name]
        differ = np.abs(got - want)
        assert np.minimum(differ, 360 - differ).max() < 1e-9


def rings_brute(value, level):
    """(points, area) of each contour, by walking from edge to edge."""
    padded = np.pad(value, 1, constant_values=level - 1)
    after = {}
    for r in range(padded.shape[0] - 1):
        for c in range(padded.shape[1] - 1):
            square = padded[r : r + 2, c : c + 2]
            high = square > level
            edge = {"t": (0, r, c), "b": (0, r + 1, c), "l": (1, r, c), "r": (1, r, c + 1)}
            corners = {(0, 0): "tl", (0, 1): "rt", (1, 0): "lb", (1, 1): "br"}
            if high.sum() in (1, 2) and (high.sum() == 1 or high[0, 0] == high[1, 1]):
                for at, (a, b) in corners.items():  # each corner inside stands alone
                    if high[at]:
                        after[edge[a]] = edge[b]
            elif high.sum() == 3:
                a, b = next(corners[at] for at in corners if not high[at])
                after[edge[b]] = edge[a]
            elif high.sum() == 2:
                a, b = {(True, True, False, False): "rl", (False, False, True, True): "lr", (True, False, True, False): "tb", (False, True, False, True): "bt"}[tuple(high.ravel().tolist())]
                after[edge[a]] = edge[b]

    def point(e):
        kind, r, c = e
        p, q = padded[r, c], padded[r, c + 1] if kind == 0 else padded[r + 1, c]
        share = (level - p) / (q - p)
        return (c - 1 + share, r - 1) if kind == 0 else (c - 1, r - 1 + share)

    out, rest = [], set(after)
    while rest:
        start = at = rest.pop()
        ring = [point(at)]
        while (at := after[at]) != start:
            rest.remove(at)
            ring.append(point(at))
        area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        out.append((len(ring), round(area, 6)))
    return sorted(out)


def test_contours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    value = rng.random((70, 90))
    value[10:60, 20:85] += np.hypot(*np.mgrid[-25:25, -32:33]) < 20
    grids, cells = grid_of(spark, value)
    levels = spark.createDataFrame([(1, 0.97), (1, 1.3), (1, 5.0)], "grid_id long, level double")
    found = contours.contours(rasters.blocks(cells), grids, levels).collect()
    for level in (0.97, 1.3, 5.0):
        own = sorted((r.n_points, round(r.area, 6)) for r in found if r.level == level)
        assert own == rings_brute(value, level) and (not own or max(own, key=lambda r: abs(r[1]))[1] > 0)  # the widest ring is an island's
    for r in found:
        assert r.coordinates[0] == r.coordinates[-1] and len(r.coordinates) == r.n_points + 1
        x = [((p.x - 10) / 45 * 90, (p.y - 36) / 35 * 70) for p in r.coordinates]
        area = sum(a * d - c * b for (a, b), (c, d) in zip(x, x[1:], strict=False)) / 2
        assert area == pytest.approx(r.area, abs=1e-3)


def test_envelopes_count_ties_and_isochrones_close_at_the_edge(spark):
    value = np.zeros((12, 12))
    value[4:10, 3:9] = 1.0
    value[6:8, 5:7] = 2.0
    grids, cells = grid_of(spark, value)
    told, rings = contours.envelopes(cells, rasters.blocks(cells), grids, 0.25, (0.5,))
    (row,) = told.collect()
    assert (row.level, row.cells, row.area_km2) == (1.0, 36, 9.0)
    assert rings.count() == 1
    hours = np.full((5, 5), np.nan)
    hours[0:3, 0:2] = [[1, 2], [3, 4], [5, 6]]
    grids, cells = grid_of(spark, hours)
    found = contours.isochrones(rasters.blocks(cells), grids, [2.5, 10.0]).collect()
    assert sorted(r.level for r in found) == [2.5, 10.0] and all(r.area > 0 for r in found)


def test_slopes_come_in_small_batches():
    """A task holds the lists of a slice of blocks, however many Spark hands it at once."""
    n, block = 3 * rasters.SLICE + 1, 4
    lists = lambda size: pa.array([[float(i % 7 + j) if j % 3 else None for j in range(size)] for i in range(n)], pa.list_(pa.float64()))
    names = ("grid_id", "by", "bx", "cells", "up", "down", "left", "right", "ny", "nx", "mean")
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array([0] * n), lists(block * block), *(lists(block) for _ in range(4)), pa.array([n * block] * n), pa.array([block] * n), pa.array([0.5] * n)], names=list(names))
    found = list(rasters._slopes(iter([batch]), 30.0, block))
    assert sum(b.num_rows for b in found) == n and max(b.num_rows for b in found) <= rasters.SLICE
    assert found[0].column("slope")[0].as_py() is not None and found[0].column("by").to_pylist() == list(range(rasters.SLICE))
