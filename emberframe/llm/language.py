"""Language identification by fusing evidence.

Text likelihoods come from byte-trigram models of labelled documents. They are fused with the language that markup
declares, and with a prior for the host: the languages that text alone sees on it, smoothed towards those of its domain,
these towards its address suffix, and these towards the corpus. The priors are grouped aggregations.

A background class stands for everything else. Its text likelihood is the least mean log-likelihood that texts of the
likeliest language and of such a length are expected to have, from all labelled rows, each judged by models without it.

Defined results. A text without a letter (null, empty, marks only) gives no text evidence; if nothing else speaks for a
language it is und and not kept. A missing host, declaration or suffix is no evidence. A declared language that no
model knows is no evidence either. Of equally likely languages the first by name is taken. Without labelled documents every row is und and
kept, as nothing speaks against it. Repeated rows are judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.gather import summed
from emberframe.llm.rows import row_of
from emberframe.llm.skew import join_groups
from emberframe.llm.tokens import forget
from emberframe.llm.url_filter import host_of
from emberframe.session import stored

CELLS = 1 << 15  #: of a language's hashed trigrams
SHARED = 0.1  #: weight of the distribution of all labelled text in that of a language, whatever the language's size
LENGTHS, BINS, LOWEST = 16, 512, -24.0  #: of the histograms of mean log-likelihoods: lengths in powers of two, bins over LOWEST..0
ENOUGH = 100  #: labelled rows of one language and length that a floor is taken from; with fewer, those of all languages, then of all lengths
REACH = 3.0  #: the floor's distance from the median, in distances of the lowest twentieth
EFFECTIVE = 60  #: trigrams that a text counts as at most; neighbouring ones aren't independent
TRUST = 0.9  #: probability that a declaration is right
STRENGTH = 20.0  #: rows of the next wider level that a level's own rows are smoothed with
CERTAIN = 0.5  #: probability of the best language below which a row is rejected

_LETTER = re.compile(r"[^\W\d_]")
_AZ = bytes(range(256)).lower()


def trigrams(text: str) -> np.ndarray:
    """Cells of the byte trigrams of a text between two spaces, A-Z lower-cased; none of an empty text."""
    raw = np.frombuffer(b" " + text.encode().translate(_AZ) + b" ", dtype=np.uint8).astype(np.uint32)
    h = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> np.ndarray:
    total, place = np.zeros((len(languages), CELLS), dtype=np.int64), {x: i for i, x in enumerate(languages)}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and lang in place:
                total[place[lang]] += np.bincount(trigrams(text), minlength=CELLS)
    return total.ravel()


def _levels(batches: Iterator[pa.RecordBatch], languages: list[str], counted) -> np.ndarray:
    """Rows by (language, length, mean log-likelihood of the text by its own language without that text)."""
    counts, shared = counted.value
    sizes, place = counts.sum(axis=1), {x: i for i, x in enumerate(languages)}
    total = np.zeros((len(languages), LENGTHS, BINS), dtype=np.int64)
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and lang in place and _LETTER.search(text):
                i, found = place[lang], trigrams(text)
                own = np.bincount(found)
                used = np.flatnonzero(own)
                others = (counts[i, used] - own[used]) / max(1, sizes[i] - len(found))
                mean = own[used] @ np.log((1 - SHARED) * others + SHARED * shared[used]) / len(found)
                total[i, _length(len(found)), int(np.clip((1 - mean / LOWEST) * BINS, 0, BINS - 1))] += 1
    return total.ravel()


def _length(n: int) -> int:
    return min(LENGTHS - 1, n.bit_length() - 1)


def floors(levels: np.ndarray) -> np.ndarray:
    """The least mean log-likelihood expected by language and length."""
    found = np.full(levels.shape[:2], LOWEST)
    of_length = levels.sum(axis=0)
    for i, j in np.ndindex(*found.shape):
        own = next((x for x in (levels[i, j], of_length[j]) if x.sum() >= ENOUGH), of_length.sum(axis=0))
        if own.any():
            upto = np.cumsum(own) / own.sum()
            low, middle = (LOWEST * (1 - np.searchsorted(upto, q) / BINS) for q in (0.05, 0.5))
            found[i, j] = middle - max(REACH * (middle - low), 0.25)
    return found


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    """(languages, (log-likelihoods of cells, floors)); every label, from all labelled rows. Both grow with the labels: 128 KB and 128 numbers each."""
    given = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    languages = sorted(r["lang"] for r in given.select("lang").distinct().collect())  # a row per label
    if not languages:
        return [], (np.zeros((CELLS, 0), dtype=np.float32), np.zeros((0, LENGTHS)))
    counts = summed(given, partial(_count, languages=languages), len(languages) * CELLS).reshape(len(languages), CELLS)
    pooled = counts.sum(axis=0)
    shared = (pooled + 0.5) / (pooled.sum() + 0.5 * CELLS)
    counted = labelled.sparkSession.sparkContext.broadcast((counts, shared))
    levels = summed(given, partial(_levels, languages=languages, counted=counted), len(languages) * LENGTHS * BINS).reshape(len(languages), LENGTHS, BINS)
    table = np.log((1 - SHARED) * counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) + SHARED * shared)
    return languages, (table.T.astype(np.float32).copy(), floors(levels))


def _likelihoods(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """For each row the tempered log-likelihoods of its text, by language and of the background; the columns beside the text stay."""
    forget()
    table, least = model.value
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            out, background = [], []
            for text in some.column("text").to_pylist():
                found = trigrams(text) if text and table.shape[1] and _LETTER.search(text) else ()
                if len(found):
                    counts = np.bincount(found)
                    used = np.flatnonzero(counts)
                    total = counts[used].astype(np.float32) @ table[used]
                    effective = min(len(found), EFFECTIVE)
                    out.append((total.astype(float) * (effective / len(found))).tolist())
                    background.append(float(least[total.argmax(), _length(len(found))]) * effective)
                else:
                    out.append(None)
                    background.append(None)
            kept = some.drop_columns(["text"])
            yield kept.append_column("likelihoods", pa.array(out, pa.list_(pa.float64()))).append_column("background", pa.array(background, pa.float64()))


def evidence_of_documents(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, page_id, text, declared, host, domain, suffix: the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(row_of(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"), none.alias("declared"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """The same of web pages: declared by the html element, host, domain and suffix from the address, text without markup."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    declared = F.lower(F.substring(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1), 1, 2))
    host = F.nullif(host_of(F.col("url")), F.lit(""))
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    part = lambda n: F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, -n, n)))
    return pages.select(F.monotonically_increasing_id().alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"), part(2).alias("domain"), part(1).alias("suffix"))


def _counts(level: Column, languages: list[str]) -> list[Column]:
    return [F.sum((F.col("seen") == i).cast("double")).alias(f"n{i}") for i in range(len(languages))]


def host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """host, n, prior: an array over languages. Each level is smoothed towards the next wider one, the widest towards even shares."""
    k = len(languages)
    seen = rows.where("seen IS NOT NULL AND host IS NOT NULL")
    # counts per host come first; wider levels are sums of them
    hosts = seen.groupBy("host").agg(F.first("domain").alias("domain"), F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("n"), *_counts(F.col("host"), languages))
    array = lambda frame: F.array(*[F.col(f"n{i}") for i in range(k)])
    smooth = lambda own, wider: F.zip_with(own, wider, lambda n, p: (n + STRENGTH * p) / (F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + STRENGTH))
    whole = hosts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(k)]).select(smooth(array(None), F.array(*[F.lit(1 / k)] * k)).alias("of_all"))
    suffixes = hosts.where("suffix IS NOT NULL").groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).crossJoin(F.broadcast(whole))  # one row
    suffixes = suffixes.select("suffix", smooth(array(None), F.col("of_all")).alias("of_suffix"))
    domains = hosts.where("domain IS NOT NULL").groupBy("domain").agg(F.first("suffix").alias("suffix"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    domains = domains.join(suffixes, "suffix").select("domain", smooth(array(None), F.col("of_suffix")).alias("of_domain"))
    hosts = hosts.join(domains, "domain", "left").crossJoin(F.broadcast(whole))  # one row
    return hosts.select("host", "n", smooth(array(None), F.coalesce("of_domain", "of_all")).alias("prior"))


def judge(evidence: DataFrame, languages: list[str], model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id, page_id, lang, probability, kept, text_lang, declared, host."""
    held = evidence.sparkSession.sparkContext.broadcast(model)  # CELLS numbers a language
    columns = [c for c in evidence.columns if c != "text"]
    schema = "row long, doc_id long, page_id long, declared string, host string, domain string, suffix string, likelihoods array<double>, background double"
    rows = stored(evidence.mapInArrow(partial(_likelihoods, model=held), schema), "likelihoods")
    if not languages:
        return rows.select("row", "doc_id", "page_id", F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    rows = rows.withColumn("seen", F.when(F.array_max("likelihoods") >= F.col("background"), best(F.col("likelihoods"))))
    priors = host_priors(rows, languages)
    total = rows.count()
    some = rows.where("host IS NOT NULL").select("host", "row", "doc_id", "page_id", "declared", "likelihoods", "background", "seen")
    none = F.lit(None).cast("array<double>")
    # every host of some row is a group, also one without text evidence
    groups = some.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).join(priors.drop("n"), "host", "left")
    with_host = join_groups(some, groups, "host", "rows", total).select(*some.columns, "prior")
    rows = with_host.unionByName(rows.where("host IS NULL").select(*some.columns).withColumn("prior", none))
    even = F.array(*[F.lit(1 / len(languages))] * len(languages))
    known = F.array_contains(names, F.col("declared"))
    said = F.when(known, F.transform(names, lambda x: F.log(F.when(x == F.col("declared"), F.lit(TRUST)).otherwise(F.lit((1 - TRUST) / max(1, len(languages) - 1))))))
    zeros = F.array(*[F.lit(0.0)] * len(languages))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.coalesce("likelihoods", zeros), F.coalesce(said, zeros)), F.transform(F.coalesce("prior", even), lambda p: F.log(p)))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    # the background's prior is that of a language where nothing is known, and a declaration speaks against it too
    other = F.col("background") + F.when(known, F.lit(float(np.log(1 - TRUST)))).otherwise(F.lit(0.0)) - F.lit(float(np.log(len(languages))))
    probability = 1.0 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")), lambda s: s + F.coalesce(F.exp(other - F.col("top")), F.lit(0.0)))
    speaks = F.col("likelihoods").isNotNull() | F.coalesce(known, F.lit(False))
    rows = rows.withColumns({"probability": probability, "fits": F.coalesce(speaks & (probability >= CERTAIN), F.lit(False))})
    return rows.select("row", "doc_id", "page_id", F.when(F.col("fits"), F.element_at(names, best(F.col("logs")) + 1)).otherwise("und").alias("lang"), "probability", F.col("fits").alias("kept"), F.element_at(names, F.col("seen") + 1).alias("text_lang"), "declared", "host")


def kept_documents(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row and kept of documents, judged by models of their own labels."""
    languages, model = train(docs)
    return judge(evidence_of_documents(docs, row), languages, model).select("row", "kept")


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The languages of all documents and all pages, by models of the labelled documents."""
    languages, model = train(documents)
    judged = judge(evidence_of_documents(documents), languages, model).unionByName(judge(evidence_of_pages(pages), languages, model))
    return judged.drop("row")
