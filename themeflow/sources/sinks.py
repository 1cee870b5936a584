"""Exports: combined items as CSV/JSON, theme tables as CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> bool:
    """Header + UTF-8 CSV files; nothing is written for an empty frame.
    Returns whether files were written."""
    if df.limit(1).count() == 0:
        return False
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return True


def export_json(df: DataFrame, path: str) -> bool:
    """JSON lines (one object per item); nothing for an empty frame."""
    if df.limit(1).count() == 0:
        return False
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def write_theme_csv(df: DataFrame, path: str, order: list) -> None:
    """A theme table (one row per theme, so small) as one ordered CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_markdown_lines(summary: DataFrame) -> DataFrame:
    """Dominance summary -> Markdown table lines (``|`` escaped, percent with
    one decimal). One text row per theme plus the two header rows, ordered
    by ``line_no``."""
    def esc(c):  # '|' -> '\|'
        return F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|")
    w = F.row_number().over(Window.orderBy(F.col("items_in_theme").desc(), F.lower("consolidated_tag"),
                                           F.col("consolidated_tag")))
    rows = summary.select(
        (w + 2).alias("line_no"),
        F.format_string("| %s | %.1f%% | %s |", esc("consolidated_tag"), F.col("cluster_dominance_percent"),
                        esc("consolidated_tag_explanation")).alias("value"))
    spark = summary.sparkSession
    head = spark.createDataFrame(
        [(1, "| Consolidated tag | Cluster dominance percentage | Consolidated tag explanation |"),
         (2, "|---|---:|---|")], "line_no long, value string")
    return head.unionByName(rows.withColumn("line_no", F.col("line_no").cast("long")))


def write_markdown(summary: DataFrame, path: str) -> None:
    lines = summary_markdown_lines(summary)
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(path)
