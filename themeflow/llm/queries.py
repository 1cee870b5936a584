"""The operators as queries over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm import (cross_polytope, decontaminate, host_reputation, interpolated_lm, jaccard_join, line_index,
                           merkle, repetition, secrets_scan, source_mix, suffix_index, warc, whitening)
from themeflow.llm.sql import HOST_REPUTATION_SQL, LINE_DEDUP_SQL, MERKLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the label with its number; junk or toxic is bad."""
    labels = _table(spark, sf_dir, "labels").dropna(subset=["quality", "toxic"])
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return host_reputation.judge_urls(_table(spark, sf_dir, "pages"),
                                      labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(suffix_index.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.digest(line_index.dedup_lines(_table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(_table(spark, sf_dir, "documents")).drop("source")


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_leaves(merkle.build_manifest(merkle.leaves_of(_table(spark, sf_dir, "documents"))))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_host_reputation": op2_host_reputation,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op10_interpolated_lm": op10_interpolated_lm,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op2_host_reputation": HOST_REPUTATION_SQL,
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
