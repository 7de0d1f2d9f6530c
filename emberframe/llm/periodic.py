"""Runs: maximal periodic stretches of words in whole texts, found by Lyndon words.

Longest Lyndon words are scanned from right to left with a stack, once under an order of the words and once under its
reverse; each run has one of them as its root under one of the two. Lyndon words are compared, and roots extended to both sides, by the
longest common extension: rolling hashes and a binary search find its length, and the words themselves are compared to verify it. No suffix
array is built.

A run of at least LEAST words repeats a sequence of LEAST // 2 words, and all of its words lie in such repeated sequences. Only
stretches that repeated sequences cover are scanned, each by itself, which loses no run; in most prose there is none.

The work is a narrow map over documents. Memory follows the longest document; nothing is shuffled.

Defined results. Null texts and texts without words have no runs and an empty collapsed text. Rows with the same doc_id, or none, are
documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.words import sequence_hashes, word_hashes

LEAST = 12  #: words of a run at least; it has two periods too
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 4_000_000  #: of texts whose results are handed over together
BASE = 0xD1342543DE82EF95
MASK = (1 << 64) - 1
RUNS = "array<struct<start:long,length:long,period:long>>"


class Extensions:
    """Longest common extensions of a sequence of word numbers."""

    def __init__(self, ids: list[int]) -> None:
        self.ids, self.array = ids, np.array(ids, dtype=np.int64)
        power, total, h = 1, [0], 0
        self.powers = [1]
        for x in ids:
            h = (h * BASE + (x + 1) * 0x9E3779B97F4A7C15) & MASK
            total.append(h)
            power = power * BASE & MASK
            self.powers.append(power)
        self.prefix = total

    def _same(self, i: int, j: int, n: int) -> bool:
        p, m = self.prefix, self.powers[n]
        return (p[i + n] - p[i] * m - p[j + n] + p[j] * m) & MASK == 0

    def ahead(self, i: int, j: int, most: int) -> int:
        """How many words from i on equal those from j on, at most this many."""
        ids, n = self.ids, 0
        while n < 8:  # most end within a few words
            if n == most or ids[i + n] != ids[j + n]:
                return n
            n += 1
        low, step = n, 8  # the first `low` are equal
        while low + step <= most and self._same(i + low, j + low, step):
            low, step = low + step, step * 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if self._same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        differ = self.array[i : i + low] != self.array[j : j + low]  # the words themselves decide
        return int(differ.argmax()) if differ.any() else low

    def behind(self, i: int, j: int, most: int) -> int:
        """How many words before i equal those before j, at most this many."""
        ids, n = self.ids, 0
        while n < 8:
            if n == most or ids[i - 1 - n] != ids[j - 1 - n]:
                return n
            n += 1
        low, step = n, 8
        while low + step <= most and self._same(i - low - step, j - low - step, step):
            low, step = low + step, step * 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if self._same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        differ = (self.array[i - low : i] != self.array[j - low : j])[::-1]
        return int(differ.argmax()) if differ.any() else low


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, found = len(ids), set()
    if n < least:
        return []
    reach = Extensions(ids)
    for reverse in (False, True):
        stack: list[int] = []  # ends of the Lyndon words that follow one another from here on, the next one last
        newest: dict[int, tuple[int, int]] = {}  # the leftmost run of each period so far
        for i in range(n - 1, -1, -1):
            j = i + 1
            while stack:
                k = stack[-1]
                most = min(j - i, k - j)
                same = reach.ahead(i, j, most)
                if same == most:
                    less = j - i < k - j  # a part of the other from its start is less
                else:
                    less = (ids[i + same] < ids[j + same]) != reverse
                if not less:
                    break
                j = stack.pop()
            stack.append(j)
            period = j - i
            known = newest.get(period)
            if known and known[0] <= i and i + 2 * period <= known[1]:
                continue
            if 2 * period > n or i + period >= n and i < period:
                continue
            end = j + reach.ahead(i, j, n - j)
            start = i - reach.behind(i, j, i)
            if end - start >= 2 * period:
                newest[period] = (start, end)
                if end - start >= least:
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches that repeated sequences of least // 2 words cover and that can hold a run."""
    n = least // 2
    grams = sequence_hashes(hashes, n)
    if len(grams) < 2:
        return []
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, grams)
    again = np.zeros(len(grams), dtype=bool)
    inside = at < len(twice)
    again[inside] = twice[at[inside]] == grams[inside]
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    change[:-n] += again[: len(hashes) - n + 1]
    change[n:] -= again
    covered = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def text_runs(text: str | None, least: int = LEAST) -> tuple[list[tuple[int, int, int]], str]:
    """A text's runs, and its words without those that a run repeats, joined by single spaces."""
    if not text:
        return [], ""
    words = text.encode("utf-8", "surrogatepass").split()  # at the white space [\x20\x09-\x0D]
    runs: list[tuple[int, int, int]] = []
    for a, b in stretches(word_hashes(text), least):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        runs += [(a + start, length, period) for start, length, period in runs_of(ids, least)]
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return runs, b" ".join(words).decode("utf-8", "surrogatepass")


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    for batch in batches:
        ids, runs, texts, held = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, rest = text_runs(text.as_py(), least)
            ids.append(doc_id)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            texts.append(rest)
            held += len(rest) + 24 * len(own)
            if held > SLICE_BYTES:
                yield rows()
                ids, runs, texts, held = [], [], [], 0
        if ids:
            yield rows()


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, runs (start, length, period; by start, then period), collapsed."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(partial(_found, least=least), f"doc_id long, runs {RUNS}, collapsed string")


def repeated_text(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten its words repeated with a period from a place on, both by the checksum of doc_id."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(places, lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int"))), " "))

    # the array is bound once, as the only element of an array that is transformed
    once = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when(h % 10 == 0, once).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    longest = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), 1)
    top = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.floor(F.lit(1000) * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
