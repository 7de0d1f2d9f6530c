"""Exact deduplication through a minimal perfect hash over historical distinct digests.

Part of the corpus counts as history. Its distinct digests are dealt to shards, and each shard gets a minimal perfect
hash whose slots hold the full 32-byte digest and the locator of the row that stays. The other rows, grouped by digest
before anything is moved, are looked up there: the slot's bytes are compared with the digest, equal ones are repeats of
history, the rest form groups among themselves.

Defined results. A null text counts as empty; empty texts (also texts of white space only) form one group. Of equal
texts the one with the most code points stays, then the smallest doc_id (null last), then, for repeated rows with the
same doc_id, the first one in the cut table, so that exactly one row of every group stays. An empty table gives no rows. Other columns are
not read; names that clash with the result's are of no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.rows import row_of
from emberframe.llm.skew import join_groups
from emberframe.session import cut

SHARD_KEYS = 2048  #: digests of history in a shard, about
SPACE = "[\\x20\\x09-\\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)

INDEX = "shard long, slots long, levels binary, bits binary, digests binary, best_chars binary, best_id binary, best_null binary, best_row binary, sizes binary"
GROUPS = "digest binary, keep_id long, keep_row long, group_size long, member boolean"


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (keys ^ (keys >> np.uint64(31))) * (_MIX + np.uint64(2 * level))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def build_hash(keys: np.ndarray, room: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, bits, slot of each key) of a minimal perfect hash of distinct 64-bit keys.

    On each level a key that has a place of its own takes it; those that collide go to the next level. A key's slot is
    the number of taken places before its own, so slots are 0 .. n-1 without gaps.
    """
    levels, parts, where, rest, start = [], [], np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 0
    while len(rest):
        size = max(8, int(room * len(rest)))
        at = (_level_hash(keys[rest], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        where[rest[placed]] = start + at[placed]
        levels.append(size)
        parts.append(alone)
        rest, start = rest[~placed], start + size
    bits = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
    rank = np.cumsum(bits) - bits
    return np.array(levels, dtype=np.int64), bits, rank[where].astype(np.int64) if len(keys) else where


def look_up(levels: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot that each key has if it is a member, -1 if it certainly isn't one; only the slot's bytes tell."""
    slots, rank, open_, start = np.full(len(keys), -1, dtype=np.int64), np.cumsum(bits) - bits, np.arange(len(keys)), 0
    for level, size in enumerate(levels.tolist()):
        at = start + (_level_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return slots


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel()


def _build(table: pa.Table) -> pa.Table:
    """The index row of one shard. Digests whose first 8 bytes are those of another digest keep a slot beside the hash."""
    digests = _digests(table["digest"])
    keys = _keys(digests)
    _, first = np.unique(keys, return_index=True)
    extra = np.setdiff1d(np.arange(len(keys)), first)
    levels, bits, slot = build_hash(keys[first])
    order = np.empty(len(keys), dtype=np.int64)
    order[slot] = first
    order[len(first):] = extra
    column = lambda name, kind: table[name].fill_null(0).to_numpy().astype(kind)[order].tobytes()
    row = {
        "shard": table["shard"][0].as_py(), "slots": len(first), "levels": levels.tobytes(), "bits": np.packbits(bits).tobytes(), "digests": digests[order].tobytes(),
        "best_chars": column("best_chars", np.int64), "best_id": column("best_id", np.int64), "best_null": table["best_id"].is_null().to_numpy().astype(np.uint8)[order].tobytes(),
        "best_row": column("best_row", np.int64), "sizes": column("size", np.int64),
    }
    return pa.Table.from_pylist([row])


def _resolve(_key, index: pa.Table, batch: pa.Table) -> pa.Table:
    """The groups of one shard: history's, with the batch's repeats counted in, and those that only the batch has."""
    rows = index.to_pylist()
    batch_digests = _digests(batch["digest"])
    new = {n: batch[n].fill_null(0).to_numpy().astype(np.int64) for n in ("best_chars", "best_id", "best_row", "size")}
    new_null = batch["best_id"].is_null().to_numpy()
    found = np.full(len(batch_digests), -1, dtype=np.int64)
    if rows:
        at = rows[0]
        digests = np.frombuffer(at["digests"], dtype=np.uint8).reshape(-1, 32)
        levels = np.frombuffer(at["levels"], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(at["bits"], dtype=np.uint8), count=int(levels.sum())).astype(bool)
        slots = look_up(levels, bits, _keys(batch_digests))
        same = slots >= 0
        same[same] = (digests[slots[same]] == batch_digests[same]).all(axis=1)
        found[same] = slots[same]
        beside = {digests[i].tobytes(): i for i in range(at["slots"], len(digests))}
        for i in np.flatnonzero(found < 0) if beside else []:
            found[i] = beside.get(batch_digests[i].tobytes(), -1)
        best = {n: np.frombuffer(at[n], dtype=np.int64).copy() for n in ("best_chars", "best_id", "best_row", "sizes")}
        best_null = np.frombuffer(at["best_null"], dtype=np.uint8).astype(bool)
    else:
        digests, best, best_null = np.zeros((0, 32), dtype=np.uint8), {n: np.zeros(0, dtype=np.int64) for n in ("best_chars", "best_id", "best_row", "sizes")}, np.zeros(0, dtype=bool)
    old, mine = found[found >= 0], np.flatnonzero(found >= 0)
    best["sizes"][old] += new["size"][mine]
    was, is_ = (best["best_chars"][old], best_null[old], best["best_id"][old], best["best_row"][old]), (new["best_chars"][mine], new_null[mine], new["best_id"][mine], new["best_row"][mine])
    better = is_[0] > was[0]
    tie = is_[0] == was[0]
    better |= tie & (is_[1] < was[1])
    tie &= is_[1] == was[1]
    better |= tie & (is_[2] < was[2])
    better |= tie & (is_[2] == was[2]) & (is_[3] < was[3])
    for name in ("best_id", "best_row"):
        best[name][old[better]] = new[name][mine[better]]
    best_null = best_null.copy()
    best_null[old[better]] = new_null[mine[better]]
    own = np.flatnonzero(found < 0)
    return pa.table({
        "digest": pa.array([d.tobytes() for d in digests] + [batch_digests[i].tobytes() for i in own], pa.binary()),
        "keep_id": pa.array(np.concatenate([best["best_id"], new["best_id"][own]]), mask=np.concatenate([best_null, new_null[own]])),
        "keep_row": np.concatenate([best["best_row"], new["best_row"][own]]),
        "group_size": np.concatenate([best["sizes"], new["size"][own]]),
        "member": np.concatenate([np.ones(len(digests), dtype=bool), np.zeros(len(own), dtype=bool)]),
    })


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One short row per document: id, code points of the text, digest of the text without white space, a row locator."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), digest.alias("digest"), row_of(row).alias("row"))


def distinct_digests(keyed: DataFrame) -> DataFrame:
    """A row per digest: its size and its best row. Sums are formed before the shuffle, so a hot digest is a row per task."""
    best = F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row"))).alias("best")
    grouped = keyed.groupBy("historic", "digest").agg(F.count(F.lit(1)).alias("size"), best)
    return grouped.select("historic", "digest", "size", F.col("best.n_chars").alias("best_chars"), F.bitwise_not("best.not_id").alias("best_id"), F.bitwise_not("best.not_row").alias("best_row"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The hash of each shard of history's distinct digests; at most about SHARD_KEYS digests are in one task's hands."""
    return history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInArrow(_build, INDEX)


def resolve(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """The groups of history and batch together."""
    dealt = batch.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_resolve, GROUPS)


def exact_dedup(docs: DataFrame, historic=None, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row.

    historic: a Column over doc_id that says which rows are history; by default every second document by checksum.
    """
    if historic is None:
        historic = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0
    keyed = cut(digests_of(docs, id_col, text_col, row).withColumn("historic", historic))
    distinct = cut(distinct_digests(keyed))
    counts = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows")).first()
    shards = max(1, -(-counts["n"] // SHARD_KEYS))
    index = build_index(distinct.where("historic"), shards)
    groups = cut(resolve(index, distinct.where("NOT historic"), shards))
    done = join_groups(keyed.select("digest", "doc_id", "row"), groups.drop("member"), "digest", "group_size", counts["rows"] or 0)
    return done.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
