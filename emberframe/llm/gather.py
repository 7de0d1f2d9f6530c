"""Adding up what tasks have counted into arrays of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK = 1 << 16  #: cells of an array that travel together
FIRST = 64  #: groups of tasks whose arrays are added up before the groups' sums are
SCHEMA = "chunk long, part long, cells binary"


def _added(table: pa.Table) -> pa.Table:
    total = None
    for packed in table["cells"]:
        cells = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.int64)
        total = cells.copy() if total is None else total + cells
    return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cells: int) -> np.ndarray:
    """The sum over df's tasks of count(batches), int64 arrays of this many cells. cells is a parameter, whatever df's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = count(batches)
        part = TaskContext.get().partitionId() % FIRST
        for chunk in range(0, cells, CHUNK):
            own = found[chunk : chunk + CHUNK]
            if own.any():
                yield pa.RecordBatch.from_pylist([{"chunk": chunk // CHUNK, "part": part, "cells": zlib.compress(own.astype(np.int64).tobytes(), 1)}])

    counted = df.mapInArrow(partial, SCHEMA)
    some = counted.groupBy("chunk", "part").applyInArrow(_added, SCHEMA)
    total = np.zeros(cells, dtype=np.int64)
    for row in some.groupBy("chunk").applyInArrow(_added, SCHEMA).toLocalIterator():
        own = np.frombuffer(zlib.decompress(bytes(row["cells"])), dtype=np.int64)
        total[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(own)] = own
    return total
