"""URL filtering: rules first, then a character language-model ratio.

Rules (host, path) are allowed or blocked; the longest that fits wins. URLs that a rule decides also train two smoothed
variable-order Markov models over bytes, one for accepted and one for rejected URLs: counts of every (context, byte) of up to ORDERS
bytes, exact, by grouped aggregation; each order's estimate is smoothed towards that of the next shorter context. URLs lie in blocks; a block
asks for the counts of its distinct (context, byte) and contexts, a join answers, and the URLs are scored beside the answers, so the
models may be of any size: nothing of them is broadcast or brought to the driver. The mean log-likelihood difference per byte is
calibrated on rule-decided URLs that the models haven't seen (a histogram of BINS values), and decides the URLs without a rule. Models read the whole
URL, with scheme, query and fragment; rules read host and path.

Defined results. A null URL is scored as an empty string: difference 0. It has an empty host and path and no rule, as has
one without ://, which is scored as it stands. If no URL, or only one kind of URL, is decided by a rule, every difference is 0 and the verdict is allow.
Repeated rows are judged alike, each for itself, and train once. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut, stored

#: (rule, verdict); a short list that is looked through for each URL
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDERS = 5  #: the longest context has ORDERS - 1 bytes
BLOCK_BITS = 12  #: 2^BLOCK_BITS URLs are a block
SMOOTHING = 2.0  #: weight of the shorter context, in observations
BINS, WIDEST = 4096, 8.0  #: of the histogram of differences, over -WIDEST..WIDEST
FOLDS = 5  #: one of FOLDS rule-decided URLs calibrates, the others train

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is the longest
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def codes(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order (rows) and byte of all urls (columns) the number of (context, byte) and that of the context; and the URLs' lengths.

    A number spells the order and its bytes, 9 bits each as byte + 1 (0 stands before a URL), so different ones never share a number.
    """
    pad = ORDERS - 1
    lengths = np.array([len(u) for u in urls], dtype=np.int64)
    raw = np.frombuffer(b"".join(b"\0" * pad + u for u in urls), dtype=np.uint8).astype(np.int64) + 1
    real = np.ones(len(raw), dtype=bool)
    starts = np.cumsum(lengths + pad) - (lengths + pad)
    for i in range(pad):
        real[starts + i] = False
    raw[~real] = 0
    at = np.flatnonzero(real)
    grams, contexts = np.empty((ORDERS, len(at)), dtype=np.int64), np.empty((ORDERS, len(at)), dtype=np.int64)
    context = np.zeros(len(at), dtype=np.int64)
    for order in range(ORDERS):
        if order:
            context = context | raw[at - order] << 9 * (order - 1)
        contexts[order] = (2 * order + 1) << 54 | context
        grams[order] = (2 * order) << 54 | context << 9 | raw[at]
    return grams, contexts, lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, accepted, rejected): counts of a batch's (context, byte) and contexts, from rows of (url, accepted)."""
    for batch in batches:
        urls, accepted = [u.encode() for u in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), dtype=np.int64)
        grams, contexts, lengths = codes(urls)
        found, of = np.unique(np.concatenate([grams.ravel(), contexts.ravel()]), return_inverse=True)
        side = np.tile(np.repeat(accepted, lengths), 2 * ORDERS)
        counts = [np.bincount(of[side == kind], minlength=len(found)) for kind in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, counts)], names=["code", "accepted", "rejected"])


def difference(urls: list[bytes], known: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean over a URL's bytes of log P(accepted) - log P(rejected). known: codes in ascending order, counts: of each, accepted and rejected; other codes have none."""
    grams, contexts, lengths = codes(urls)

    def of(kind: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(asked.shape)
        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[place] == asked, kind[place], 0)

    logs = []
    for kind in counts:
        p = np.full(grams.shape[1], 1 / 256)
        for order in range(ORDERS):
            p = (of(kind, grams[order]) + SMOOTHING * p) / (of(kind, contexts[order]) + SMOOTHING)
        logs.append(np.log(p))
    ends = np.concatenate([[0], np.cumsum(logs[0] - logs[1])])
    at = np.cumsum(lengths)
    return (ends[at] - ends[at - lengths]) / np.maximum(lengths, 1)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct codes of each block's URLs, from rows of (block, url)."""
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            grams, contexts, _ = codes([u.encode() for u in batch.column(1).filter(pa.array(blocks == block)).to_pylist()])
            found = np.unique(np.concatenate([grams.ravel(), contexts.ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], names=["block", "code"])


def _scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
    known, first = np.unique(answers["code"].to_numpy(), return_index=True)  # a block that was split has asked twice
    counts = tuple(answers[c].to_numpy()[first].astype(float) for c in ("accepted", "rejected"))
    d = difference([u.encode() for u in rows["address"].to_pylist()], known, counts)
    return rows.drop_columns(["block"]).append_column("difference", pa.array(d, pa.float64()))


def calibrate(histogram: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic curve over the difference, both kinds weighing the same; (0, 0) if one is missing."""
    n = histogram.reshape(2, BINS).astype(float)
    if not n.sum(axis=1).all():
        return 0.0, 0.0
    n /= n.sum(axis=1, keepdims=True)
    x, weight = (np.arange(BINS) + 0.5) / BINS * 2 * WIDEST - WIDEST, n.sum(axis=0)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a small penalty on the scale so that separable data end too
        p = 1 / (1 + np.exp(-(a * x + b)))
        slope = np.array([((n[1] - weight * p) * x).sum() - 1e-3 * a, (n[1] - weight * p).sum()])
        v = weight * p * (1 - p)
        bend = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(bend, slope)
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
    return float(a), float(b)


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, difference, accepted (the calibrated probability)."""
    url = F.col(url_col)
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url.cast("string"), F.lit("")).alias("address"))
    known = known.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    known = stored(known.withColumn("block", block), "urls")
    fold = F.pmod(F.crc32("address"), F.lit(FOLDS))
    accepted = (F.col("fits.verdict") == "allow").cast("int")
    trained = known.where((fold != 0) & F.col("fits").isNotNull()).select("address", accepted.alias("accepted")).distinct()
    model = cut(trained.mapInArrow(_count, "code long, accepted long, rejected long").groupBy("code").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    asked = known.select("block", "address").mapInArrow(_asked, "block long, code long")
    # without one of the kinds there are no answers, so that no URL differs
    both = model.where(F.col("code") == F.lit(1 << 54)).where("accepted > 0 AND rejected > 0").count() > 0
    answers = asked.join(model if both else model.limit(0), "code").select("block", "code", "accepted", "rejected")
    schema = "page_id long, host string, path string, address string, fits struct<rule:string,verdict:string>, difference double"
    scored = cut(known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, schema))
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("difference") + WIDEST) / (2 * WIDEST) * BINS)))
    held = scored.where((fold == 0) & F.col("fits").isNotNull()).select("address", accepted.alias("kind"), bin_of.cast("int").alias("bin")).distinct().groupBy("kind", "bin").count()
    histogram = np.zeros((2, BINS), dtype=np.int64)
    for r in held.collect():  # 2 * BINS rows at most
        histogram[r["kind"], r["bin"]] = r["count"]
    scale, shift = calibrate(histogram) if both else (0.0, 0.0)
    chance = 1 / (1 + F.exp(-(F.lit(scale) * F.col("difference") + F.lit(shift))))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("accepted") >= 0.5, "allow").otherwise("block"))
    return scored.withColumn("accepted", chance).select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "difference", "accepted")
