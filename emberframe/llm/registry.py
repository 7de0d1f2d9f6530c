"""Queries and SQL of this subpackage: opN_<name> for each dealt operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import alignment, curriculum, exact_dedup, interpolation, language, near_dedup, nearest, packing, periodic, quality, simhash, token_frames, url_filter
from emberframe.session import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_frames(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4).drop("row")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.ordered_plan(table(spark, sf_dir, "documents"))


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.periodic_runs(docs.withColumn("text", periodic.repeated_text(F.col("doc_id"), F.col("text")))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_frames, op2_language_id, op3_url_ratio, op4_exact_dedup, op5_near_dedup, op6_nearest, op7_packing, op8_curriculum, op9_interpolation, op10_quality, op11_alignment, op12_periodic_runs, op13_simhash)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op5_near_dedup": near_dedup.ORACLE_SQL, "op8_curriculum": curriculum.ORACLE_SQL}
