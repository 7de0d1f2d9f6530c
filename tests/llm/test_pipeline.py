"""The pipeline as a whole, and its stages on awkward tables."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from emberframe.llm import curriculum, packing, rows
from emberframe.session import stored

from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def crowd(spark, docs):
    """docs with columns of the names that the pipeline itself might use, and enough sentences for the language models."""
    from pyspark.sql import functions as F

    words = {"en": "the house and the river are not of this world", "de": "das haus und der fluss sind nicht von dieser welt"}
    more = [(1000 + i, " ".join(f"{words[lang]} {prose(i, 12)}" for _ in range(1 + i % 40)), lang, "abc"[i % 3], 1) for i in range(240) for lang in [("en", "de")[i % 2]]]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    return stored(both.withColumns({"__row": F.lit(0), "Row_Number": F.lit(0), "position": F.lit(1), "row": F.lit(5), "kept": F.lit(False), "order0": F.lit(3)}), "crowd")


def staged(spark, docs, sf_dir=""):
    """The result of each stage, written and read again as the check does it."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        out.append((name, docs))
    return out


def test_stages_keep_columns_and_order(spark, crowd):
    done = staged(spark, crowd)
    for _, result in done[:-1]:
        assert result.columns == crowd.columns
    exact, near, mixed, packed = (r for _, r in done[1:])
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in exact.collect()]
    assert len(texts) == len(set(texts)) and len(texts) > 200
    assert 0 < near.count() <= exact.count()
    # the documents in the order of the files that mixing has written
    order = [i for path in sorted(f.removeprefix("file://") for f in mixed.inputFiles()) for i in pq.read_table(path)["doc_id"].to_pylist()]
    planned = curriculum.plan(near).select("doc_id", "positions").collect()
    at = defaultdict(list)
    for r in planned:
        at[r.doc_id] += r.positions
    assert sorted(map(str, order)) == sorted(str(r.doc_id) for r in planned for _ in r.positions)
    once = {i: p[0] for i, p in at.items() if len(p) == 1}
    seen = [once[i] for i in order if i in once]
    assert seen == sorted(seen)
    # sequences follow it: what is packed first stands first, whole blocks apart
    first = defaultdict(lambda: None)
    place = {i: k for k, i in enumerate(order) if len(at[i]) == 1}
    for r in packed.orderBy("sequence_id", "offset").collect():
        if r.doc_id in place:
            first.setdefault(r.sequence_id >> 36, []).append(place[r.doc_id])
    groups = [v for _, v in sorted(first.items())]
    assert len(groups) > 1 and all(max(a) < min(b) for a, b in zip(groups, groups[1:], strict=False))


def test_order_is_read_back_however_files_are_split(spark):
    df = stored(spark.range(0, 5000, 1, 7).orderBy("id").repartitionByRange(7, "id").sortWithinPartitions("id"), "ordered")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = df.orderBy(*rows.stored_order(df))
            assert [r.id for r in again.collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert rows.stored_order(spark.range(3)) == []
    named = stored(spark.range(3).withColumnRenamed("id", "_metadata"), "named")
    assert len(rows.stored_order(named)) == 2 and named.orderBy(*rows.stored_order(named)).count() == 3


def test_packing_in_order(spark, docs):
    import public_tokenizers
    from pyspark.sql import functions as F

    numbered = docs.where("doc_id >= 100").withColumn("place", F.col("doc_id") * 7 % 64)
    packed = packing.pack(numbered, public_tokenizers.path("byte_bpe_50k.json"), block=1, order=[F.col("place")]).orderBy("sequence_id").collect()
    first = defaultdict(list)
    for r in packed:
        first[r.sequence_id >> 36].append(r.doc_id * 7 % 64)
    groups = [v for _, v in sorted(first.items())]
    assert len(groups) > 1 and all(max(a) <= min(b) for a, b in zip(groups, groups[1:], strict=False))


def test_clashing_columns_change_nothing(spark, crowd):
    plain = crowd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:3]:
        a, b = (sorted(str(r.doc_id) for r in stage(spark, d, "").collect()) for d in (crowd, stored(plain, "plain")))
        assert a == b


def test_empty_table(spark, no_docs):
    for _, result in staged(spark, no_docs):
        assert result.collect() == []


def test_numbers_of_rows_are_those_of_their_places(spark, docs, crowd):
    """The same whatever the split, one for each row, also with columns of the metadata's name, and stored where there are no files."""
    named = stored(docs.select("doc_id", "text").withColumnsRenamed({"doc_id": "_metadata", "text": "file_path"}), "named")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for table in (docs, crowd, named, docs.limit(5)):
        numbers, name = rows.numbered(table)
        assert numbers.columns == [*table.columns, name] and name.lower() not in {c.lower() for c in table.columns}
        found = sorted(map(str, numbers.collect()))
        assert len({r[name] for r in numbers.collect()}) == len(found) == table.count()
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
            assert sorted(map(str, numbers.collect())) == found
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
