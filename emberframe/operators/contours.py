"""Contours of rasters: marching squares over blocks, segments joined to rings.

A block sees the first row, column and corner of the blocks below and to the right of it, so each square of four cells belongs to
one block. A grid is framed by cells below the level, so every contour is closed. Segments run with the higher cells on one side; where two
squares meet they share an edge of the lattice. A block joins its own segments to chains; one that is closed is a ring, and the others
meet at the edges where they leave their blocks, so only chains across blocks are joined as components. A ring is put in order in one
task: as a polygon it is one value anyway.

Defined results. A cell above the level is inside, one at the level isn't. Where opposite corners are inside alone, they stay
apart. Missing cells count as `fill`. A grid that nowhere exceeds the level has no ring. Coordinates of a cell are those of its
south-west corner scaled by the grid's extent (rows from the south).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.graph import components, forest
from emberframe.operators.rasters import BLOCK, rows_of
from emberframe.operators.surfaces import mass_levels
from emberframe.session import cut, shuffle_partitions

TOP, LEFT, BOTTOM, RIGHT = range(4)
#: by corners inside (upper left 1, upper right 2, lower left 4, lower right 8): segments from edge to edge, the inside on one hand
SEGMENTS = {
    1: ((TOP, LEFT),), 2: ((RIGHT, TOP),), 3: ((RIGHT, LEFT),), 4: ((LEFT, BOTTOM),), 5: ((TOP, BOTTOM),), 6: ((RIGHT, TOP), (LEFT, BOTTOM)), 7: ((RIGHT, BOTTOM),), 8: ((BOTTOM, RIGHT),),
    9: ((TOP, LEFT), (BOTTOM, RIGHT)), 10: ((BOTTOM, TOP),), 11: ((BOTTOM, LEFT),), 12: ((LEFT, RIGHT),), 13: ((TOP, RIGHT),), 14: ((LEFT, TOP),),
}
SCHEMA = "grid_id long, level double, e1 long, e2 long, x1 double, y1 double, x2 double, y2 double, chain long, open boolean, enters boolean, leaves boolean"
PIECES = 10_000  #: of blocks that are handed on together, at least
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


def _chains(e1: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's segments: the least edge of their chain, whether it is open, and whether they are where it enters and leaves the block."""
    edges, of = np.unique(np.concatenate([e1, e2]), return_inverse=True)
    x, y = of[: len(e1)], of[len(e1) :]
    label = np.arange(len(edges))
    moved, least = forest(len(edges), x, y)
    label[moved] = least
    enters, leaves, open_at = np.bincount(y, minlength=len(edges))[x] == 0, np.bincount(x, minlength=len(edges))[y] == 0, np.zeros(len(edges), bool)
    open_at[label[x[enters]]] = open_at[label[x[leaves]]] = True
    return edges[label[x]], open_at[label[x]], enters, leaves


def _squares(batches: Iterator[pa.RecordBatch], block: int, fill: float) -> Iterator[pa.RecordBatch]:
    made = []
    for batch in batches:
        for r in rows_of(batch):
            # corners from one row and column before the block (used at the grid's edge alone) to one after it
            whole = np.full((block + 2, block + 2), fill)
            square = lambda a: np.where(np.isnan(a), fill, a)
            if r["own"] is not None:
                whole[1:-1, 1:-1] = square(r["own"]).reshape(block, block)
            for side, at in (("below", np.s_[-1, 1:-1]), ("right", np.s_[1:-1, -1]), ("corner", np.s_[-1, -1])):
                if r[side] is not None:
                    whole[at] = square(r[side]) if side != "corner" else square(r[side])[0]
            for level in r["levels"].tolist():
                columns = _pieces(whole.copy(), level, r["ny"], r["nx"], r["by"] * block, r["bx"] * block, block)
                if columns is not None:
                    n = len(columns[0])
                    made.append([np.full(n, r["grid_id"]), np.full(n, level), *columns, *_chains(*columns[:2])])
            if sum(len(m[0]) for m in made) >= PIECES:
                yield _batch(made)
                made = []
    if made:
        yield _batch(made)


def _batch(made: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=NAMES)


def _pieces(whole: np.ndarray, level: float, ny: int, nx: int, y0: int, x0: int, block: int) -> list[np.ndarray] | None:
    """e1, e2, x1, y1, x2, y2 of the segments in a block's squares, or None where there are none."""
    y, x = np.arange(y0 - 1, y0 + block + 1), np.arange(x0 - 1, x0 + block + 1)
    whole[(y < 0) | (y >= ny), :] = level - 1
    whole[:, (x < 0) | (x >= nx)] = level - 1
    a, b = (0 if y0 == 0 else 1), (0 if x0 == 0 else 1)
    part = whole[a : min(block, ny - y0) + 2, b : min(block, nx - x0) + 2]
    high = (part > level).astype(int)
    case = high[:-1, :-1] + 2 * high[:-1, 1:] + 4 * high[1:, :-1] + 8 * high[1:, 1:]
    row, col = np.nonzero((case > 0) & (case < 15))
    if not len(row):
        return None
    kind, ul, ur, ll, lr = case[row, col], part[row, col], part[row, col + 1], part[row + 1, col], part[row + 1, col + 1]
    row, col = row + y0 - 1 + a, col + x0 - 1 + b
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda p, q: (level - p) / (q - p)
        points = {TOP: (col + share(ul, ur), row), BOTTOM: (col + share(ll, lr), row + 1), LEFT: (col, row + share(ul, ll)), RIGHT: (col + 1, row + share(ur, lr))}
    number = lambda r, c, upright: ((r + 1) * (nx + 2) + c + 1) * 2 + upright
    edges = {TOP: number(row, col, 0), BOTTOM: number(row + 1, col, 0), LEFT: number(row, col, 1), RIGHT: number(row, col + 1, 1)}
    parts = []
    for value, segments in SEGMENTS.items():
        own = np.flatnonzero(kind == value)
        for p, q in segments if len(own) else ():
            parts.append([edges[p][own], edges[q][own], *(np.asarray(v, dtype=float)[own] for v in (*points[p], *points[q]))])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def segments(blocks: DataFrame, grids: DataFrame, levels: DataFrame, fill: float = 0.0, block: int = BLOCK) -> DataFrame:
    """grid_id, level, e1, e2, x1, y1, x2, y2, chain, open, enters, leaves: pieces of the contours at the levels (grid_id, level), in columns and rows.

    e1 and e2 are edges of the lattice, chain is the least one of what a block joins; an open chain enters and leaves the block.
    """
    cells = F.col("cells")
    first_column = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.element_at(cells, i * block + 1))
    sent = F.array(*[F.struct((F.col("by") + dy).alias("by"), (F.col("bx") + dx).alias("bx"), F.lit(side).alias("side"), part.alias("part"))
                     for dy, dx, side, part in ((0, 0, "own", cells), (-1, 0, "below", F.slice(cells, 1, block)), (0, -1, "right", first_column), (-1, -1, "corner", F.slice(cells, 1, 1)))])
    given = blocks.select("grid_id", F.explode(sent).alias("s")).select("grid_id", "s.*").where("by >= 0 AND bx >= 0")
    whole = given.groupBy("grid_id", "by", "bx").agg(*[F.first(F.when(F.col("side") == s, F.col("part")), ignorenulls=True).alias(s) for s in ("own", "below", "right", "corner")])
    known = grids.select("grid_id", "nx", "ny").join(levels.groupBy("grid_id").agg(F.collect_list(F.col("level").cast("double")).alias("levels")), "grid_id")
    asked = whole.join(known, "grid_id")
    # by their number: blocks are few bytes for the work in them, so Spark would put all of them into one task
    dealt = asked.repartition(shuffle_partitions(blocks.sparkSession), "grid_id", "by", "bx")
    return dealt.mapInArrow(partial(_squares, block=block, fill=fill), SCHEMA)


def ringed(pieces: DataFrame) -> DataFrame:
    """pieces with ring: the component of their chains, a number within (grid_id, level). Closed chains are rings already."""
    number = lambda c: F.xxhash64("grid_id", "level", c)
    held = cut(pieces)
    ends = held.where("enters OR leaves").select(number("chain").alias("a"), F.explode(F.array_compact(F.array(F.when(F.col("enters"), number("e1")), F.when(F.col("leaves"), number("e2"))))).alias("b"))
    labels = components(ends).withColumnsRenamed({"id": "node", "component": "ring"})
    across = held.where("open").withColumn("node", number("chain")).join(labels, "node").drop("node")
    return held.where("NOT open").withColumn("ring", number("chain")).unionByName(across).drop("chain", "open", "enters", "leaves")


def measured(pieces: DataFrame) -> DataFrame:
    """grid_id, level, ring, n_points, area: of each ring, in cells. An island's area is positive, that of a hole in it negative."""
    return pieces.groupBy("grid_id", "level", "ring").agg(F.count(F.lit(1)).alias("n_points"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def _ordered(table: pa.Table) -> pa.Table:
    e1, e2, x, y = (table[c].to_numpy() for c in ("e1", "e2", "x1", "y1"))
    after, at, points = {a: i for i, a in enumerate(e1.tolist())}, int(e1.argmin()), []
    start = at
    while True:  # from the least edge on
        points.append({"x": float(x[at]), "y": float(y[at])})
        at = after[int(e2[at])]
        if at == start:
            break
    points.append(points[0])
    first = table.slice(0, 1)
    return pa.table({"grid_id": first["grid_id"], "level": first["level"], "ring": first["ring"], "coordinates": pa.array([points], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})


def rings(pieces: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, level, ring, coordinates: closed rings in degrees to six places, in the order of their edges."""
    ordered = pieces.groupBy("grid_id", "level", "ring").applyInArrow(_ordered, "grid_id long, level double, ring long, coordinates array<struct<x:double,y:double>>")
    lon = lambda p: F.round(F.col("west") + p["x"] / F.col("nx") * (F.col("east") - F.col("west")), 6)
    lat = lambda p: F.round(F.col("south") + p["y"] / F.col("ny") * (F.col("north") - F.col("south")), 6)
    placed = ordered.join(grids, "grid_id").withColumn("coordinates", F.transform("coordinates", lambda p: F.struct(lon(p).alias("x"), lat(p).alias("y"))))
    return placed.select("grid_id", "level", "ring", "coordinates")


def contours(blocks: DataFrame, grids: DataFrame, levels: DataFrame, fill: float = 0.0) -> DataFrame:
    """Rings at the levels (grid_id, level), with n_points and area in cells."""
    pieces = cut(ringed(segments(blocks, grids, levels, fill)))
    return rings(pieces, grids).join(measured(pieces), ["grid_id", "level", "ring"])


def isochrones(blocks: DataFrame, grids: DataFrame, hours: Sequence[float]) -> DataFrame:
    """Rings around what an arrival surface says is reached within so many hours, a level each; cells never reached count as twice the last one."""
    never = -2 * float(max(hours)) - 1
    late = F.transform("cells", lambda v: F.when(v.isNull() | F.isnan(v), F.lit(never)).otherwise(F.greatest(F.lit(never), -v)))
    levels = grids.select("grid_id", F.explode(F.array(*[F.lit(-float(h)) for h in hours])).alias("level"))
    return contours(blocks.withColumn("cells", late), grids, levels, never).withColumn("level", -F.col("level"))


def envelopes(cells: DataFrame, blocks: DataFrame, grids: DataFrame, cell_km2: float, shares: Sequence[float] = (0.5, 0.8, 0.9)) -> tuple[DataFrame, DataFrame]:
    """(grid_id, share, level, cells, area_km2; its rings): down to which value cells hold a share of all likelihood, the area of all cells that reach it, ties included."""
    held = cut(mass_levels(cells, "grid_id", shares).withColumn("area_km2", F.round(F.col("cells") * cell_km2, 4)))
    return held, contours(blocks, grids, held.select("grid_id", "level").distinct())
