"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A text's fingerprint has a bit for each bit of the XXH64 of its word shingles, set where over half of them have it. Two
fingerprints of BYTES bytes that differ in at most DIFFER bits agree in at least BYTES - DIFFER bytes at their positions. The index lists distinct
fingerprints under positional bytes, three positions together: the position triples are chosen so that any BYTES - DIFFER = 4 agreeing
positions hold one of them whole (20 of the 56 triples), so every pair to be linked meets in a list. There the shared
positional bytes of a pair are tallied, pairs that reach the guaranteed minimum are retained, and their bits are compared.

Lists longer than BLOCK are compared block by block. A task hands on a forest of the links it has found, not every pair, so a group of
like fingerprints costs a row for each of them. Equal fingerprints are one member. Lists too long for one task can't arise.

Defined results. Texts without words, also null ones, have the fingerprint zero and are linked like any other. Words in fewer number than a
shingle has are one shingle. Rows without doc_id are linked too; component_id is the smallest doc_id, missing where no row of the
component has one. Rows with the same doc_id are rows of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.near_dedup import components
from emberframe.llm.skew import join_groups
from emberframe.session import cut, shuffle_partitions, stored

WORDS = 4  #: of a shingle
SEED = 42
BYTES = 8  #: of a fingerprint
DIFFER = 4  #: bits in which linked fingerprints differ at most
BLOCK = 2048  #: members of a list that are compared at once
PART = 1 << 15  #: shingles whose bits are counted at once
_SEVEN, _EIGHTH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def triples() -> list[tuple[int, int, int]]:
    """Position triples of which one lies within any four positions: all of one third, or two of one third and one of the next."""
    thirds = [i % 3 for i in range(BYTES)]
    turns = lambda t: sorted(thirds[i] for i in t)
    return [t for t in combinations(range(BYTES), 3) if turns(t) in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2])]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined, n = b" ".join(found), min(words, len(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    begin, end = (ends - sizes)[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(begin), PART):
        some = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + PART], end[at : at + PART], strict=True)], dtype=np.uint64)
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(begin)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py(), words, seed) for text in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "id"])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id: the fingerprint as a signed 64-bit integer, for every row."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(partial(_prints, words=words, seed=seed), "doc_id long, id long")


def postings(members: DataFrame) -> DataFrame:
    """list, id: each fingerprint under each triple of positional bytes. The list's number holds the triple and its bytes."""
    byte = lambda i: F.shiftrightunsigned("id", 8 * i).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for k, (a, b, c) in enumerate(triples())]
    return members.select(F.explode(F.array(*keys)).alias("list"), "id")


def dealt(index: DataFrame) -> DataFrame:
    """cell, side, id: the members of each list to compare. A list longer than BLOCK is compared block by block."""
    sizes = cut(index.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    many = sizes.agg(F.sum("size")).first()[0] or 0
    held = join_groups(index, sizes, "list", "size", many).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), own.alias("side")))
    return held.select("list", F.explode(meets).alias("meet"), "id").select(F.xxhash64("list", "meet.x", "meet.y").alias("cell"), "list", "meet.x", "meet.y", (F.col("meet.side") == F.col("meet.x")).alias("first"), "id")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of fingerprints: whether the tally of shared positional bytes reaches the minimum and few enough bits differ."""
    other = a ^ b
    differ = (((other & _SEVEN) + _SEVEN) | other) & _EIGHTH  # the top bit of each byte that differs
    fine = BYTES - np.bitwise_count(differ) >= BYTES - DIFFER
    fine[fine] = np.bitwise_count(other[fine]) <= DIFFER
    return fine


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n members: each member that isn't the least of its component, and that least one."""
    label = np.arange(n)
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:  # to the root
            further = label[label]
            if (further == label).all():
                break
            label = further
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the links within cells, from rows in the order of cell, list, x and y. A cell's rows may go on in the next batch."""
    rest = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool), np.zeros(0, np.int64)]

    def pairs(key: list[np.ndarray], first: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        values, of = np.unique(ids, return_inverse=True)
        u, found_x, found_y, held = ids.view(np.uint64), [], [], 0
        begin = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]) if len(ids) else np.zeros(0, bool)
        cell = np.cumsum(begin)
        within = (key[2] == key[3]) if len(ids) else begin  # one block with itself
        size = np.bincount(cell)[cell] if len(ids) else cell
        place = np.arange(len(ids)) - np.flatnonzero(begin)[cell - 1] if len(ids) else cell
        forests: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            nonlocal found_x, found_y, held
            if found_x:
                forests.append(forest(len(values), of[np.concatenate(found_x)], of[np.concatenate(found_y)]))
                found_x, found_y, held = [], [], 0

        open_ = np.arange(len(ids))
        for shift in range(1, int(size.max()) if len(ids) else 0):
            open_ = open_[place[open_] + shift < size[open_]]
            a = open_[within[open_] | (first[open_] != first[open_ + shift])]
            fine = a[linked(u[a], u[a + shift])]
            if len(fine):
                found_x.append(fine)
                found_y.append(fine + shift)
                held += len(fine)
                if held > 1 << 20:
                    fold()
        fold()
        moved, least = (np.concatenate(p) for p in zip(*forests, strict=True)) if forests else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[least])], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)]) for i, old in enumerate(rest)]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in now[:4]], axis=0))
        to = int(last[-1]) + 1 if len(last) else 0
        out = pairs([k[:to] for k in now[:4]], now[4][:to], now[5][:to])
        if out.num_rows:
            yield out
        rest = [k[to:] for k in now]
    out = pairs(rest[:4], rest[4], rest[5])
    if out.num_rows:
        yield out


def edges(members: DataFrame) -> DataFrame:
    """a, b: links that connect what pairs of distinct fingerprints (id) within DIFFER bits connect."""
    cells = dealt(postings(members))
    ordered = cells.repartition(shuffle_partitions(members.sparkSession), "cell").sortWithinPartitions("cell", "list", "x", "y")
    return ordered.select("cell", "list", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "first", "id").mapInArrow(_compared, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    described = stored(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    members = cut(described.groupBy("id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labels = components(cut(edges(members.select("id"))))
    named = cut(members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    total = described.count()
    of = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = join_groups(named.select("component", "id", "copies"), of, "component", "members", total).select("id", "copies", "component_id")
    return join_groups(described, known, "id", "copies", total).select("doc_id", F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id")
