"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and its word with a uniform one. The weights
depend on how often the context was seen, in buckets of powers of two, and are learned by expectation-maximisation:
part of the training documents is deleted from the counts, and the weights make those documents likeliest.

Each task reads its documents in blocks and sends every block's distinct n-grams, packed and cut by hash range, to the range's task;
that adds the counts of all blocks up and answers each block with the totals of its n-grams. Answers are kept by the
documents' task in the shared folder, where scoring reads its own. The n-grams of the whole corpus are counted, and no
task holds more than its range or its block.

Defined results. A null or empty text is its end alone. A null doc_id counts as empty text where the folds are drawn. Rows with the same doc_id are
scored each for itself. Without training documents the estimates are uniform. An empty table gives no rows. Other columns are not read.
docs must be a stored table or a narrow, repeatable plan over one: it is read three times and a block that isn't the same again
ends the job with an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.gather import summed
from emberframe.llm.words import A, distinct, mixed, word_hashes
from emberframe.session import shuffle_partitions, work_dir

BLOCK_TOKENS = 1_500_000  #: a block ends when it has so many
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
HELD_OUT = (7, 2)  #: documents whose checksum has this remainder aren't learned from
DELETED = 8  #: one of DELETED training documents teaches the weights
BUCKETS = 32  #: of context counts, by powers of two
LEVELS = 64  #: of probabilities, half powers of two; the last is 0
ROUNDS = 60
BYTES = 6  #: of a hash that are sent; with the range that it falls in they tell n-grams apart
LOW = np.uint64((1 << 48) - 1)

COUNTS = "part long, block long, orders long, range long, grams binary, kept binary, deleted binary, tokens long, check long"
ANSWERS = "part long, block long, orders long, range long, kept binary, all binary, distinct long, check long"


def fold(doc_id: int | None) -> int:
    """0: held out, 1: kept for the counts, 2: deleted from them to learn the weights."""
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return 0 if crc % HELD_OUT[0] == HELD_OUT[1] else 2 if crc // HELD_OUT[0] % DELETED == 0 else 1


class Block:
    """Some documents' tokens; the same again whenever the same documents are read."""

    def __init__(self, ids: list[int | None], tokens: list[np.ndarray]) -> None:
        self.ids = ids
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        token = np.concatenate(tokens)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        ends = np.cumsum(self.lengths)
        before[ends - self.lengths] = BEGIN
        self.folds = np.array([fold(i) for i in ids])
        self.check = zlib.crc32(np.array([i or 0 for i in ids], dtype=np.int64).tobytes(), len(token))
        with np.errstate(over="ignore"):
            self.grams = [mixed(token + np.uint64(1)), mixed(before * A + token)]  # by order

    def fold_of_tokens(self) -> np.ndarray:
        return np.repeat(self.folds, self.lengths)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    ids, tokens, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(np.append(word_hashes(text), END))
                held += len(tokens[-1])
                if held >= BLOCK_TOKENS:
                    yield Block(ids, tokens)
                    ids, tokens, held = [], [], 0
    if ids:
        yield Block(ids, tokens)


def cuts(sorted_grams: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of the hash begin and end among sorted hashes."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_grams, edges), [len(sorted_grams)]])


def narrow(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def widen(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // BYTES, 8), dtype=np.uint8)
    out[:, :BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, block in enumerate(blocks(batches)):
        which = block.fold_of_tokens()
        for order, grams in enumerate(block.grams):
            found, place = np.unique(grams, return_inverse=True)
            kept, deleted = (np.bincount(place[which == f], minlength=len(found)) for f in (1, 2))
            edges = cuts(found, ranges)
            rows = [{
                "part": part, "block": number, "orders": order, "range": i, "grams": narrow(found[a:b]), "kept": pack_counts(kept[a:b]), "deleted": pack_counts(deleted[a:b]),
                "tokens": int((kept[a:b] + deleted[a:b]).sum()), "check": block.check,
            } for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]  # fmt: skip  # noqa: B905
            yield pa.RecordBatch.from_pylist(rows)


def _answer(table: pa.Table) -> pa.Table:
    """The totals of one range's n-grams, for each block in the order in which it sent them."""
    sent = [widen(g) for g in table["grams"].to_pylist()]
    found, place = np.unique(np.concatenate(sent), return_inverse=True)
    kept, deleted = (np.bincount(place, weights=np.concatenate([unpack_counts(c) for c in table[n].to_pylist()]), minlength=len(found)).astype(np.int64) for n in ("kept", "deleted"))
    every = kept + deleted
    ends = np.cumsum([len(s) for s in sent])
    mine = [place[e - len(s) : e] for s, e in zip(sent, ends, strict=True)]
    distinct = [0] * len(sent)
    distinct[0] = int((every > 0).sum())
    plain = {n: table[n] for n in ("part", "block", "orders", "range")}
    return pa.table(plain | {"kept": pa.array([pack_counts(kept[m]) for m in mine], pa.binary()), "all": pa.array([pack_counts(every[m]) for m in mine], pa.binary()), "distinct": distinct, "check": table["check"]})


class Answers:
    """What came back for this task's blocks."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(f"{path}/part={TaskContext.get().partitionId()}")
        self.rows: dict[tuple[int, int], list[dict]] = {}
        if store.get_file_info(name).type != fs.FileType.NotFound:
            for file in store.get_file_info(fs.FileSelector(name)):
                if file.base_name.endswith(".parquet"):
                    for row in pq.ParquetFile(store.open_input_file(file.path)).read(["block", "orders", "range", "kept", "all", "check"]).to_pylist():
                        self.rows.setdefault((row["block"], row["orders"]), []).append(row)

    def totals(self, number: int, block: Block, order: int, what: str) -> np.ndarray:
        """Of the block's distinct n-grams in ascending order."""
        rows = sorted(self.rows.get((number, order), []), key=lambda r: r["range"])
        if not rows or any(r["check"] != block.check for r in rows):
            raise RuntimeError("the documents were dealt to tasks in another way than before; store them first")
        return np.concatenate([unpack_counts(r[what]) for r in rows])


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def estimates(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram estimate, word estimate, context count) of all tokens of documents of these lengths, from the counts of their words and bigrams."""
    starts = np.cumsum(lengths) - lengths
    context = np.empty_like(one)
    context[1:] = one[:-1]
    begins = one[np.cumsum(lengths) - 1]  # a document begins as often as it ends
    context[starts] = begins
    return two / np.maximum(context, 1), one / max(total, 1), context


def level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum((-2 * np.log2(np.maximum(p, 1e-30))).astype(np.int64), LEVELS - 2), LEVELS - 1)


def _histogram(batches: Iterator[pa.RecordBatch], path: str, kept_tokens: int) -> np.ndarray:
    """Deleted documents' tokens by bucket and levels of the two estimates that the kept counts give."""
    cells = np.zeros(BUCKETS * LEVELS * LEVELS, dtype=np.int64)
    answers = Answers(path)
    for number, block in enumerate(blocks(batches)):
        mine = block.fold_of_tokens() == 2
        if not mine.any():
            continue
        counts = []
        for order, grams in enumerate(block.grams):
            asked, place = np.unique(grams[mine], return_inverse=True)
            counts.append(answers.totals(number, block, order, "kept")[np.searchsorted(distinct(grams), asked)][place])
        two, one, context = estimates(*counts, block.lengths[block.folds == 2], kept_tokens)
        at = (bucket(context) * LEVELS + level(two)) * LEVELS + level(one)
        cells += np.bincount(at, minlength=len(cells))
    return cells


def learn_weights(cells: np.ndarray, uniform: float) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, word and uniform estimate, by expectation-maximisation."""
    n = cells.reshape(BUCKETS, LEVELS, LEVELS).astype(float)
    value = 2.0 ** -((np.arange(LEVELS) + 0.5) / 2)
    value[-1] = 0.0
    p = np.stack([np.broadcast_to(value[:, None], (LEVELS, LEVELS)), np.broadcast_to(value[None, :], (LEVELS, LEVELS)), np.full((LEVELS, LEVELS), uniform)])
    weights = np.full((BUCKETS, 3), 1 / 3)
    prior = np.full(3, 1 / 3)
    for _ in range(ROUNDS):
        share = weights[:, :, None, None] * p[None]
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        got = (share * n[:, None]).sum(axis=(2, 3))
        prior = (got.sum(axis=0) + 1) / (got.sum() + 3)
        weights = (got + 10 * prior) / (got.sum(axis=1, keepdims=True) + 10)
    return np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum(axis=1, keepdims=True)


def _score(batches: Iterator[pa.RecordBatch], path: str, tokens: int, vocabulary: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    answers = Answers(path)
    for number, block in enumerate(blocks(batches)):
        counts = []
        for order, grams in enumerate(block.grams):
            counts.append(answers.totals(number, block, order, "all")[np.unique(grams, return_inverse=True)[1]])
        two, one, context = estimates(*counts, block.lengths, tokens)
        w = weights[bucket(context)]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (vocabulary + 1))
        base = np.log10((counts[0] + 1) / (tokens + vocabulary + 1))
        starts = np.cumsum(block.lengths) - block.lengths
        total = lambda x: np.add.reduceat(x, starts)
        yield pa.RecordBatch.from_arrays([
            pa.array(block.ids, pa.int64()), pa.array(block.folds == 0), pa.array(block.lengths), pa.array(total((counts[0] > 0).astype(np.int64))),
            pa.array(np.full(len(block.ids), tokens, dtype=np.int64)), pa.array(total(base)), pa.array(total(model)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges, path = shuffle_partitions(spark), work_dir(spark, "ngram-counts")
    sent = given.mapInArrow(partial(_send, ranges=ranges), COUNTS)
    answered = sent.groupBy("orders", "range").applyInArrow(_answer, ANSWERS)
    # one folder for each task that will ask, with few files in it
    answered.repartition(ranges, "part").write.partitionBy("part").parquet(path)
    answers = spark.read.schema(ANSWERS).parquet(path)
    vocabulary = answers.where("orders = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    kept, every = _tokens(given)
    cells = summed(given, partial(_histogram, path=path, kept_tokens=kept), BUCKETS * LEVELS * LEVELS)
    weights = learn_weights(cells, 1 / (vocabulary + 1))
    return given.mapInArrow(partial(_score, path=path, tokens=every, vocabulary=vocabulary, weights=weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _tokens(given: DataFrame) -> tuple[int, int]:
    """Tokens of the kept and of all training documents."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    trained = F.pmod(crc, F.lit(HELD_OUT[0])) != HELD_OUT[1]
    deleted = F.pmod(F.floor(crc / HELD_OUT[0]), F.lit(DELETED)) == 0
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1
    row = given.where(trained).agg(F.sum(F.when(deleted, 0).otherwise(tokens)).alias("kept"), F.sum(tokens).alias("every")).first()
    return row["kept"] or 0, row["every"] or 0


