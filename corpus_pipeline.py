"""The training-data pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Within a stage, decisions travel by a row number that is stored with the
table, under a name that the table doesn't have. The order that mixing gives is that of the files and rows it is written
in; packing packs each file as it stands and numbers sequences by files and rows, so they follow the curriculum and no text is shuffled for it.

Defined results. Nulls in any column, repeated rows and columns of any name pass through the stages as their operators state. An empty
table gives an empty result. Packing a DataFrame that wasn't read from files takes its rows as they come.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import curriculum, exact_dedup, language, near_dedup, packing
from emberframe.llm.rows import keep_rows, numbered, stored_order
from emberframe.session import stored, table


def decided(docs: DataFrame, operator: Callable[..., DataFrame]) -> DataFrame:
    """docs' rows that the operator keeps, in docs' columns."""
    held, row = numbered(docs)
    return keep_rows(held, row, operator(held, row=row)).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return decided(docs, language.kept_documents)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return decided(docs, exact_dedup.exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return decided(docs, near_dedup.near_groups)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return curriculum.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in sequences, which follow the order that docs were written in."""
    held, row = numbered(docs) if stored_order(docs) else (docs, None)
    return packing.pack(held, public_tokenizers.path("byte_bpe_50k.json"), row=row)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources to target weights", mixing), ("packing", pack)]

ORACLE_SQL = None  # tokenizing and the language models are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
