"""Quality scores from random-indexing word vectors and a small network.

Words (and the marks at their ends, as words of their own) fall into BUCKETS. Each bucket has a sparse random index
vector; a bucket's word vector is the sum of its neighbours' index vectors over the whole corpus. A document pools the
unit-length vectors of its words: their mean and mean square. A two-layer network, trained on labelled documents outside
the held-out fold and stopped and calibrated by temperature on a part of those, gives the probability of label 1.

Defined results. Null and empty texts pool to zeros and are scored like any text. Labels without doc_id or quality are left out; of
several labels of a doc_id the mean counts, 0.5 as 1. Without labels of both kinds outside the held-out fold all scores are 0.5. Repeated rows are
scored each for itself; a null doc_id counts as empty text where the folds are drawn. An empty table gives no rows. Other
columns, as lang and source, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.gather import summed
from emberframe.session import stored

BUCKETS, DIMENSIONS = 1 << 14, 32
WINDOW = 2  #: neighbours on either side
HIDDEN = 32
SAMPLE = 20_000  #: labelled documents that train the network, about, drawn by checksum
FOLDS = 5  #: documents whose checksum is divisible by it are held out
THRESHOLD = 0.3
MEMO_WORDS = 400_000
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_index = np.random.default_rng(11)
PLACE = _index.integers(DIMENSIONS, size=(BUCKETS, 2))  #: of the 1 and of the -1 in a bucket's index vector
PLACE[:, 1] = (PLACE[:, 0] + 1 + _index.integers(DIMENSIONS - 1, size=BUCKETS)) % DIMENSIONS


class _Buckets(dict):
    """A word's bucket, and that of its end marks in the upper half (0: none)."""

    def __missing__(self, word: bytes) -> int:
        core = word.rstrip(MARKS)
        of = lambda part: xxhash.xxh3_64_intdigest(part) % (BUCKETS - 1) + 1
        found = (of(core) if core else 0) | (of(b"\0" + word[len(core) :]) if len(core) < len(word) else 0) << 32
        if len(word) < 64:
            self[word] = found
        return found


_buckets = _Buckets()


def bucketed(text: str | None) -> np.ndarray:
    """The buckets of a text's words and end marks, in order."""
    found = text.encode().split() if text else []
    if len(_buckets) > MEMO_WORDS:
        _buckets.clear()
    both = np.fromiter(map(_buckets.__getitem__, found), dtype=np.int64, count=len(found))
    flat = np.stack([both & 0xFFFFFFFF, both >> 32], axis=1).ravel()
    return flat[flat > 0]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(BUCKETS * DIMENSIONS)

    def add(parts: list[np.ndarray]) -> None:
        gap = np.zeros(WINDOW, dtype=np.int64)  # bucket 0 parts documents
        t = np.concatenate([x for p in parts for x in (p, gap)])
        for offset in range(1, WINDOW + 1):
            a, b = t[:-offset], t[offset:]
            real = (a > 0) & (b > 0)
            a, b = a[real], b[real]
            for word, near in ((a, b), (b, a)):
                for sign, column in ((1, 0), (-1, 1)):
                    total.__iadd__(sign * np.bincount(word * DIMENSIONS + PLACE[near, column], minlength=len(total)))

    parts, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            parts.append(bucketed(text.as_py()))
            held += len(parts[-1])
            if held > 500_000:
                add(parts)
                parts, held = [], 0
    if parts:
        add(parts)
    return total.astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIMENSIONS) unit vectors from all texts."""
    sums = summed(docs.select(F.col(text_col).alias("text")), _neighbours, BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS).astype(float)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    table = vectors.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            out = np.zeros((some.num_rows, 2 * DIMENSIONS), dtype=np.float32)
            for i, text in enumerate(some.column(1).to_pylist()):
                found = bucketed(text)
                if len(found):
                    counts = np.bincount(found, minlength=1)
                    used = np.flatnonzero(counts)
                    weight = (counts[used] / len(found)).astype(np.float32)
                    own = table[used]
                    out[i, :DIMENSIONS], out[i, DIMENSIONS:] = weight @ own, weight @ (own * own)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["doc_id", "pooled"])


class Network:
    """Two layers; fit() stops at the best of the epochs on a validation part and sets the temperature there."""

    def __init__(self, inputs: int) -> None:
        rng = np.random.default_rng(5)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [rng.normal(size=(inputs, HIDDEN)) / inputs**0.5, np.zeros(HIDDEN), rng.normal(size=HIDDEN) / HIDDEN**0.5, np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, epochs: int = 40) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng, train = np.random.default_rng(3), np.flatnonzero(~check)
        moments, best, step = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights], (np.inf, self.weights), 0
        z = (x - self.mean) / self.scale
        for _ in range(epochs):
            order = rng.permutation(train)
            for at in range(0, len(order), 128):
                i = order[at : at + 128]
                a, b, c, d = self.weights
                h = np.tanh(z[i] @ a + b)
                e = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y[i]) / len(i)
                back = np.outer(e, c) * (1 - h * h)
                slopes = [z[i].T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]
                step += 1
                for w, g, m in zip(self.weights, slopes, moments, strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    w -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            if (now := self._loss(x[check], y[check])) < best[0]:
                best = now, [w.copy() for w in self.weights]
        self.weights = best[1]
        losses = []
        for t in np.geomspace(0.25, 8, 41):
            self.temperature = t
            losses.append((self._loss(x[check], y[check]), t))
        self.temperature = min(losses)[1]

    def _loss(self, x: np.ndarray, y: np.ndarray) -> float:
        p = np.clip(self.probabilities(x), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def _scores(batches: Iterator[pa.RecordBatch], network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
            p = network.probabilities(x) if network else np.full(batch.num_rows, 0.5)
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs, text_col))  # BUCKETS of them, whatever the corpus
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pooled = stored(given.mapInArrow(partial(_pool, vectors=vectors), "doc_id long, pooled binary"), "pooled")
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(F.pmod(crc, F.lit(FOLDS)) != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    every = max(1, -(-known.count() // SAMPLE))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).join(pooled.dropDuplicates(["doc_id"]), "doc_id").orderBy("doc_id").limit(2 * SAMPLE).toArrow()
    y, network = sample["quality"].to_numpy().astype(float), None
    if len(set(y.tolist())) == 2 and len(y) >= 10:
        x = np.frombuffer(b"".join(sample["pooled"].to_pylist()), dtype=np.float32).reshape(len(y), -1).astype(float)
        network = Network(x.shape[1])
        network.fit(x, y, np.arange(len(y)) % 5 == 0)
    return pooled.mapInArrow(partial(_scores, network=network), "doc_id long, held_out boolean, score double, predicted int")
