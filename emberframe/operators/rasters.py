"""Rasters as tables of square blocks: building, sampling at points and polygons, slope and aspect.

A raster has a row of geometry (grid_id, west, south, east, north, nx, ny) and blocks (grid_id, by, bx, cells): BLOCK x BLOCK values in
rows from the top of the block, null where nothing is known, and nulls beyond the grid's edge. Rows count from the north (the default) or from
the south. A point meets one block by its number and picks its cell there, so a raster of any size is neither broadcast nor joined cell by cell.

Defined results. A point outside the bounds, or on a null or non-finite cell, has no value. Where bounds have no extent, the
first cell is meant. Grids without blocks and blocks without a grid give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import shuffle_partitions

BLOCK = 64
SLICE = 64  #: blocks that a task works on at once, of those that Spark hands it
GEOMETRY = ("grid_id", "west", "south", "east", "north", "nx", "ny")


def _blocked(table: pa.Table, block: int) -> pa.Table:
    first = table.slice(0, 1).to_pylist()[0]
    cells = np.full(block * block, np.nan)
    cells[table["at"].to_numpy()] = table["value"].to_numpy()
    return pa.table({"grid_id": [first["grid_id"]], "by": [first["by"]], "bx": [first["bx"]], "cells": _listed([cells])})


def blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of cells (grid_id, row, col, value), one value for each cell. A group is a block: block * block rows at most."""
    at = F.pmod("row", F.lit(block)) * block + F.pmod("col", F.lit(block))
    dealt = cells.where("value IS NOT NULL").select("grid_id", F.floor(F.col("row") / block).alias("by"), F.floor(F.col("col") / block).alias("bx"), at.cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    # by their number: blocks are few bytes for the work in them, so Spark would put all of them into one task
    dealt = dealt.repartition(shuffle_partitions(cells.sparkSession), "grid_id", "by", "bx")
    return dealt.groupBy("grid_id", "by", "bx").applyInArrow(lambda t: _blocked(t, block), "grid_id long, by long, bx long, cells array<double>")


def cell_of(lon: Column, lat: Column, origin: str = "north") -> tuple[Column, Column]:
    """(row, col) of a point in a grid whose geometry stands beside it."""
    place = lambda share, extent, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor(share / F.greatest(F.lit(1e-12), extent) * F.col(n))))
    down = F.col("north") - lat if origin == "north" else lat - F.col("south")
    return place(down, F.col("north") - F.col("south"), "ny").cast("long"), place(lon - F.col("west"), F.col("east") - F.col("west"), "nx").cast("long")


def sampled(points: DataFrame, grids: DataFrame, bands: dict[str, DataFrame], origin: str = "north", block: int = BLOCK) -> DataFrame:
    """points (key, grid_id, lon, lat) with a column for each band: the value of the cell that the point is in, or null.

    Grids are rows of geometry, joined on grid_id like any table; the blocks of each band are met by (grid_id, by, bx).
    """
    row, col = cell_of(F.col("lon"), F.col("lat"), origin)
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    placed = points.join(grids.select(*GEOMETRY), "grid_id", "left").withColumns({"__row": F.when(inside, row), "__col": F.when(inside, col)})
    placed = placed.withColumns({"__by": F.floor(F.col("__row") / block), "__bx": F.floor(F.col("__col") / block)})
    for name, own in bands.items():
        met = own.select(F.col("grid_id").alias("__grid"), F.col("by").alias("__y"), F.col("bx").alias("__x"), F.col("cells").alias("__cells"))
        on = (F.col("grid_id") == F.col("__grid")) & (F.col("__by") == F.col("__y")) & (F.col("__bx") == F.col("__x"))
        value = F.get("__cells", (F.pmod("__row", F.lit(block)) * block + F.pmod("__col", F.lit(block))).cast("int"))
        placed = placed.join(met, on, "left").withColumn(name, F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)).drop("__grid", "__y", "__x", "__cells")
    return placed.select(*points.columns, *bands)


def least_of_shapes(shapes: DataFrame, grids: DataFrame, bands: dict[str, DataFrame], key: str, origin: str = "north") -> DataFrame:
    """Per key the least value of each band at its centre (lon, lat) and at the vertices of its ring (array of x, y; null: the centre alone)."""
    centre = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    points = shapes.select(key, "grid_id", F.explode(F.concat(centre, F.coalesce("ring", F.array().cast("array<struct<x:double,y:double>>")))).alias("p")).select(key, "grid_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return sampled(points, grids, bands, origin).groupBy(key).agg(*[F.min(b).alias(b) for b in bands])


def exposure(structures: DataFrame, grids: DataFrame, arrival: DataFrame) -> DataFrame:
    """structure_id, hours: when the modelled fire first reaches a structure (structure_id, grid_id, lon, lat, ring) or its nearest corner; null: never."""
    return least_of_shapes(structures, grids, {"hours": arrival}, "structure_id")


def trigger_points(points: DataFrame, grids: DataFrame, bands: dict[str, DataFrame]) -> DataFrame:
    """points (point_id, grid_id, lon, lat) with each band's hours to two places and soonest (earliest, else median), which is null where the fire doesn't come.

    Order by soonest with nulls last: a point that the model doesn't reach is reported, after the others.
    """
    found = sampled(points, grids, bands)
    rounded = {b: F.floor(F.col(b) * 100 + 0.5) / 100 for b in bands}  # by the number itself, not by its decimal digits
    return found.withColumns(rounded).withColumn("soonest", F.coalesce(*[F.col(b) for b in ("earliest", "median") if b in bands]))


def arrival_warnings(positions: DataFrame, grids: DataFrame, bands: dict[str, DataFrame], warning_hours: float = 2.0) -> DataFrame:
    """The positions (point_id, ...) that the fire is modelled to reach within warning_hours, by the earliest band, with severity."""
    soon = trigger_points(positions, grids, bands).where(F.col("soonest") <= warning_hours)
    return soon.withColumn("severity", F.when(F.col("soonest") <= warning_hours / 2, "high").otherwise("elevated"))


def _haloed(blocks: DataFrame, grids: DataFrame, block: int) -> DataFrame:
    """Blocks with the edges of their four neighbours (up, down, left, right), one exchange of edges each way, and the grid's mean for missing cells."""
    cells = F.col("cells")
    row = lambda i: F.slice(cells, i * block + 1, block)
    col = lambda j: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.element_at(cells, i * block + (j + 1)))
    sent = F.array(*[F.struct((F.col("by") + dy).alias("by"), (F.col("bx") + dx).alias("bx"), F.lit(side).alias("side"), edge.alias("edge"))
                     for dy, dx, side, edge in ((1, 0, "up", row(block - 1)), (-1, 0, "down", row(0)), (0, 1, "left", col(block - 1)), (0, -1, "right", col(0)))])
    edges = blocks.select("grid_id", F.explode(sent).alias("e")).select("grid_id", "e.*")
    pivot = edges.groupBy("grid_id", "by", "bx").agg(*[F.first(F.when(F.col("side") == s, F.col("edge")), ignorenulls=True).alias(s) for s in ("up", "down", "left", "right")])
    mean = blocks.select("grid_id", F.explode("cells").alias("v")).groupBy("grid_id").agg(F.avg("v").alias("mean"))
    shape = grids.select("grid_id", "nx", "ny").join(mean, "grid_id")
    return blocks.join(pivot, ["grid_id", "by", "bx"], "left").join(shape, "grid_id")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one at a time, lists as arrays with NaN for null: a list of Python's own floats takes four times the room."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            value = column[i]
            row[name] = value.values.to_numpy(zero_copy_only=False).astype(float) if isinstance(value, pa.ListScalar) and value.is_valid else value.as_py()
        yield row


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of equal length, with null for NaN and infinities."""
    flat = np.concatenate(arrays)
    values = pa.array(flat, mask=~np.isfinite(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(arrays) + 1, dtype=np.int32) * len(arrays[0])), values)


def _slopes(batches: Iterator[pa.RecordBatch], resolution: float, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield _slopes_of(batch.slice(at, SLICE), resolution, block)


def _slopes_of(batch: pa.RecordBatch, resolution: float, block: int) -> pa.RecordBatch:
    out = {"grid_id": [], "by": [], "bx": [], "slope": [], "aspect": []}
    for r in rows_of(batch):
        ny, nx = min(block, r["ny"] - r["by"] * block), min(block, r["nx"] - r["bx"] * block)
        whole = np.full((block + 2, block + 2), np.nan)
        whole[1:-1, 1:-1] = r["cells"].reshape(block, block)
        for side, at in (("up", np.s_[0, 1:-1]), ("down", np.s_[-1, 1:-1]), ("left", np.s_[1:-1, 0]), ("right", np.s_[1:-1, -1])):
            if r[side] is not None:
                whole[at] = r[side]
        whole = np.where(np.isnan(whole), r["mean"] if r["mean"] is not None else 0.0, whole)
        y, x = np.arange(ny) + r["by"] * block, np.arange(nx) + r["bx"] * block

        def gradient(axis: int, at: np.ndarray, n: int) -> np.ndarray:
            # inner cells: half the difference of both neighbours; the grid's first and last: of the one that there is
            here = whole[1 : ny + 1, 1 : nx + 1]
            before = whole[0:ny, 1 : nx + 1] if axis == 0 else whole[1 : ny + 1, 0:nx]
            after = whole[2 : ny + 2, 1 : nx + 1] if axis == 0 else whole[1 : ny + 1, 2 : nx + 2]
            line = (at[:, None] if axis == 0 else at[None, :]) + np.zeros((ny, nx), dtype=int)
            return np.where(line == 0, after - here, np.where(line == n - 1, here - before, (after - before) / 2)) / resolution

        dy, dx = gradient(0, y, r["ny"]), gradient(1, x, r["nx"])
        for name, value in (("slope", np.arctan(np.hypot(dx, dy))), ("aspect", np.degrees(np.arctan2(-dx, dy)) % 360.0)):
            full = np.full((block, block), np.nan)
            full[:ny, :nx] = value
            out[name].append(full.ravel())
        for name in ("grid_id", "by", "bx"):
            out[name].append(r[name])
    return pa.RecordBatch.from_arrays([_listed(v) if k in ("slope", "aspect") else pa.array(v, pa.int64()) for k, v in out.items()], names=list(out))


def slope_aspect(blocks: DataFrame, grids: DataFrame, resolution_m: float, block: int = BLOCK) -> DataFrame:
    """grid_id, by, bx, slope (radians), aspect (degrees from north, downhill): finite differences over blocks and their neighbours' edges.

    Rows from the north, at least two rows and columns. Missing cells, whole blocks too, count as the grid's mean.
    """
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    every = grids.withColumn("by", count("ny")).withColumn("bx", count("nx")).select("grid_id", "by", "bx")
    whole = every.join(blocks, ["grid_id", "by", "bx"], "left").withColumn("cells", F.coalesce("cells", F.array_repeat(F.lit(None).cast("double"), block * block)))
    known = _haloed(whole, grids, block)
    return known.mapInArrow(partial(_slopes, resolution=resolution_m, block=block), "grid_id long, by long, bx long, slope array<double>, aspect array<double>")


def cells_of(blocks: DataFrame, grids: DataFrame, *bands: str, block: int = BLOCK) -> DataFrame:
    """grid_id, row, col and the bands of every cell within the grid."""
    some = blocks.select("grid_id", "by", "bx", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(block * block - 1)).alias("at"), *bands)).alias("c"))
    row, col = F.col("by") * block + F.floor(F.col("c.at") / block), F.col("bx") * block + F.pmod("c.at", F.lit(block))
    placed = some.select("grid_id", row.alias("row"), col.alias("col"), *[F.col(f"c.{b}").alias(b) for b in bands])
    return placed.join(grids.select("grid_id", "nx", "ny"), "grid_id").where("row < ny AND col < nx").drop("nx", "ny")
