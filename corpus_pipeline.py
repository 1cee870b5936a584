"""A corpus pipeline of the operators in ``themeflow.llm``.

``STAGES`` are (name, function) pairs. Each function takes
``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet and
reads it again as the next one's documents. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm.decontaminate import remove_contaminated
from themeflow.llm.jaccard_join import JoinSettings, one_of_each
from themeflow.llm.line_index import dedup_lines
from themeflow.llm.repetition import keep_clean
from themeflow.llm.source_mix import mix_report
from themeflow.llm.stored import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; ``n_chars`` follows the text."""
    out = dedup_lines(docs).drop("__lines")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, index 0.8), the smallest document stays."""
    return one_of_each(docs, JoinSettings(k=5, percent=80, best_rounds=1))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of the sources takes."""
    return mix_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
