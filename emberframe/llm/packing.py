"""Packing of whole documents into training sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window; full windows stand alone. Rests longer than half a window are halved (unless
whole rests are asked for), so that a window holds several items, and gather in blocks of BLOCK windows' ids. Within a block, multiway differencing
merges the two partial partitions of the largest imbalance, the fullest part of one with the emptiest of the other, until one
partition is left: near-equal windows. As long as one of them exceeds the capacity, the window count rises by one and the block is
dealt anew. Nothing is moved or cut after differencing: every window is a part of its partition.

The work is a narrow map: memory is bounded by a batch and a block. Where an order is given, documents are first dealt to tasks by
ranges of it, and sequence numbers follow the order from block to block. Documents that stand in files in their order aren't dealt at all: each
stretch of rows that a task reads of a file is packed by itself, and its sequences are numbered from the file and the stretch's first row.

Defined results. A null or empty text is its end id alone, one piece. Every row is packed by itself, also rows with the
same doc_id (or none). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.tokens import encoder, trim
from emberframe.session import shuffle_partitions

WINDOW = 1024  #: ids in a sequence at most
BLOCK = 64  #: windows that are balanced against each other, about
TEXTS = 2_000_000  #: bytes of texts that are encoded together: four times as many take 160 MB more of a worker

FILE_BITS, ROW_BITS, WINDOW_BITS = 16, 26, 21  #: of a sequence's number: its file, its stretch's first row there, and windows for each row (a text has less than 2^31 bytes)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """sizes' indexes in k parts of near-equal sums, by multiway differencing; the fullest part first."""
    # a partial partition: its parts as (minus the sum, indexes) in order, the fullest first; absent ones are empty
    heap = [(-size, i, [(-size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k  # so many parts of b meet parts of a: its fullest the emptiest
        if over <= 0 and len(b) == 1:
            insort(a, b[0])
        elif over <= 0:
            a = sorted(a + b)
        else:
            keep = len(a) - over
            a = sorted(a[:keep] + [(x + y, p + q) for (x, p), (y, q) in zip(a[keep:], reversed(b[:over]), strict=True)] + b[over:])
        made += 1
        heapq.heappush(heap, (a[0][0] - (a[-1][0] if len(a) == k else 0), made, a))
    return [list(indexes) for _, indexes in heap[0][2]] if heap else []


def halved(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of an item's pieces: two near-equal ones if it is longer than half the capacity."""
    first = -(-size // 2)
    return [(0, first), (first, size - first)] if 2 * size > capacity and size > 1 else [(0, size)]


def pack_sizes(sizes: list[int], capacity: int = WINDOW, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index of the item, start in it, length), none beyond the capacity; as few as differencing finds from the least possible count on. cut: long items are halved first."""
    pieces = [(i, start, length) for i, size in enumerate(sizes) for start, length in (halved(size, capacity) if cut else [(0, size)])]
    lengths = [length for _, _, length in pieces]
    if pieces and max(lengths) > capacity:
        raise ValueError("an item is larger than a window")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(lengths, k)
        if not parts or sum(lengths[i] for i in parts[0]) <= capacity:
            return [[pieces[i] for i in part] for part in parts]
        k += 1


def first_sequence(number: int) -> int:
    """The first number of the sequences of a stretch of a file, whose first row has this number (rows.numbered: file << 40, plus the row's place). Later stretches have larger ones."""
    file, row = number >> 40, number & ((1 << 40) - 1)
    if file >> FILE_BITS or row >> ROW_BITS:
        raise ValueError(f"sequences are numbered in up to {1 << FILE_BITS} files of {1 << ROW_BITS} rows")
    return (file << ROW_BITS | row) << WINDOW_BITS


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, window: int, block: int, cut: bool) -> Iterator[pa.RecordBatch]:
    trim()  # stages before this one ran in the same worker
    encode, end = encoder(vocabulary, batch=TEXTS).encode, np.array([end_id], dtype="<u4").tobytes()
    sequence, out, pool, held, due = TaskContext.get().partitionId() << 36, [], [], 0, -1  # a pool's rests: doc_id, start, ids, doc_tokens

    def close() -> None:
        nonlocal sequence, pool, held
        for pieces in pack_sizes([len(p[2]) // 4 for p in pool], window, cut):
            offset = 0
            for i, at, length in pieces:
                doc_id, start, ids, n = pool[i]
                out.append((doc_id, start + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset))
                offset += length
            sequence += bool(pieces)
        pool, held = [], 0

    def rows() -> pa.RecordBatch:
        # a missing doc_id stays missing
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for batch in batches:
        numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc_id, ids, number in zip(batch.column(0).to_pylist(), encode(batch.column(1)), numbers, strict=True):
            if number is not None:
                if number != due:  # another file or another part of it
                    close()
                    sequence = first_sequence(number)
                due = number + 1
            ids += end
            n = len(ids) // 4
            start = n // window * window
            for at in range(0, start, window):
                out.append((doc_id, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), n, sequence, 0))
                sequence += 1
            if start < n:
                pool.append((doc_id, start, ids[4 * start :], n))
                held += n - start
                if held >= block * window:
                    close()
            if len(out) > 20_000:
                yield rows()
    if pool:
        close()
    if out:
        yield rows()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, block: int = BLOCK, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", order: Sequence[Column] = (), row: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. vocabulary: path of a tokenizers file.

    order: columns by whose ranges documents are dealt; sequences of a block of documents come before those of later ones.
    row: the column of the rows' places in files, as rows.numbered gives it; then the order is that of these, and tasks pack what they read.
    """
    place = [F.col(row).alias("place")] if row else []
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *place, *[c.alias(f"order{i}") for i, c in enumerate(order)])
    if order:
        by = [f"order{i}" for i in range(len(order))]
        given = given.repartitionByRange(shuffle_partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    return given.select("doc_id", "text", *(["place"] if row else [])).mapInArrow(partial(_packed, vocabulary=vocabulary, end_id=end_id, window=window, block=block, cut=cut), SCHEMA)
