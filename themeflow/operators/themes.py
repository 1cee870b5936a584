"""Theme reports: Pareto table, dominance summary, chart frames.

Every report first aggregates item-sized data down to one row per theme
(partial + final hash aggregation, so a hot theme never lands whole in one
task), and only then orders or ranks. Top-n ranks come from one rollup, whose
grand total sorts before the themes: a distributed top-k of n + 1 rows
(``orderBy().limit()`` -> TakeOrderedAndProject) has all a report needs, in one
scan and without a job of its own. An unbounded ranking uses the
range-partitioned running sum of ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.functions.text import (clean_label, clean_text, percent_1dp, sentiment_bucket,
                                      sentiment_label)
from themeflow.operators.filters import chart_theme_rows, theme_rows
from themeflow.operators.ordering import with_running_sum


def theme_order(count_col: str, theme_col: str) -> list[Column]:
    """Count descending, then case-insensitive name, then exact name."""
    return [F.col(count_col).desc(), F.lower(F.col(theme_col)).asc(), F.col(theme_col).asc()]


def _ranked(rows: DataFrame, group: Column, name: str, aggregates: list[Column], count_col: str,
            top_n: int | None) -> DataFrame:
    """Per group: the aggregates, ``__rank`` by count, ``__cum`` (running
    count) and ``__total`` (count over all groups, also those cut off)."""
    if top_n is not None and top_n < 0:
        raise ValueError("top_n must be >= 0 (0 or None keeps all themes)")
    rows = rows.withColumn(name, group)
    order = theme_order(count_col, name)
    if not top_n:
        counts = rows.groupBy(name).agg(*aggregates)
        ranked = with_running_sum(counts, count_col, order, "__cum", index_name="__rank")
        # the ranked frame is stored: its total is no second scan of the items
        return ranked.withColumn("__total", ranked.agg(F.max("__cum")).scalar())
    both = rows.rollup(name).agg(*aggregates, F.grouping_id().alias("__all"))
    order = [F.col("__all").desc(), *order]
    w = Window.orderBy(*order)          # over top_n + 1 rows, the first of which is the grand total
    top = (both.orderBy(*order).limit(top_n + 1)
           .withColumn("__total", F.first(count_col).over(w))
           .withColumn("__rank", F.row_number().over(w) - 1)
           .withColumn("__cum", F.sum(count_col).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__total")))
    return top.filter(F.col("__all") == 0).drop("__all")


def pareto(ann: DataFrame, top_n: int | None = S.DEFAULT_TOP_N, include_reaction_only: bool = False,
           include_unclustered: bool = False) -> DataFrame:
    """Pareto table of themes.

    Grouping is on the tag as stored; the label is cleaned afterwards, so
    dirty twins of one tag stay separate rows. Shares are against the total
    over all themes, also those cut by ``top_n``."""
    rows = theme_rows(ann, include_reaction_only, include_unclustered)
    out = _ranked(rows, F.col("consolidated_tag"), "__tag", [
        F.count(F.lit(1)).alias("items_in_theme"),
        F.count_if(F.col("item_type") == "post").alias("post_items"),
        F.count_if(F.col("item_type") == "comment").alias("comment_items"),
    ], "items_in_theme", top_n)
    return out.select(
        F.col("__rank").cast("int").alias("rank"),
        clean_label("__tag").alias("theme"),
        F.col("items_in_theme"),
        (F.col("items_in_theme") / F.col("__total") * 100).alias("share_percent"),
        F.col("__cum").cast("long").alias("cumulative_items"),
        (F.col("__cum") / F.col("__total") * 100).alias("cumulative_share_percent"),
        F.col("post_items"),
        F.col("comment_items"),
        F.col("__total").cast("long").alias("total_clustered_items"),
    )


def dominance_summary(ann: DataFrame, include_reaction_only: bool = False,
                      include_unclustered: bool = False) -> DataFrame:
    """Share of each cleaned theme (1 decimal) with its most frequent
    non-empty cleaned explanation ('' when none; ties -> smallest text)."""
    rows = theme_rows(ann, include_reaction_only, include_unclustered).select(
        clean_text("consolidated_tag", S.UNCLUSTERED).alias("consolidated_tag"),
        clean_text("cluster_explanation").alias("__expl"),
    )
    # one pass: counts per (tag, explanation) incl. '' are the partial result
    pairs = rows.groupBy("consolidated_tag", "__expl").agg(F.count(F.lit(1)).alias("__n"))
    per_tag = pairs.groupBy("consolidated_tag").agg(
        F.sum("__n").alias("__count"),
        F.min_by(F.when(F.col("__expl") != "", F.col("__expl")),
                 F.when(F.col("__expl") != "", F.struct((-F.col("__n")).alias("n"), F.col("__expl").alias("e"))))
        .alias("__mode"),
    )
    # the total reads the shuffle of ``pairs`` again, not the items
    out = per_tag.withColumn("__total", pairs.agg(F.sum("__n")).scalar())
    return out.select(
        "consolidated_tag",
        percent_1dp(F.col("__count") / F.col("__total") * 100).alias("cluster_dominance_percent"),
        F.coalesce(F.col("__mode"), F.lit("")).alias("consolidated_tag_explanation"),
        F.col("__count").alias("items_in_theme"),
    )


def theme_counts(ann: DataFrame) -> DataFrame:
    """Chart theme counts (substantive, cleaned theme not Unclustered)."""
    return (chart_theme_rows(ann)
            .groupBy(clean_label("consolidated_tag").alias("theme"))
            .agg(F.count(F.lit(1)).alias("count")))


def dominance_chart(ann: DataFrame, top_n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """Bar and Pareto chart data: top-n themes, percent of all chart rows and
    cumulative percent."""
    out = _ranked(chart_theme_rows(ann), clean_label("consolidated_tag"), "theme",
                  [F.count(F.lit(1)).alias("count")], "count", top_n)
    return out.select(
        F.col("__rank").cast("int").alias("rank"), "theme", "count",
        (F.col("count") / F.col("__total") * 100).alias("percent"),
        (F.col("__cum") / F.col("__total") * 100).alias("cumulative_percent"),
    )


def compact_themes(df: DataFrame, column: str = "consolidated_tag", top_n: int = S.COMPACT_TOP_N,
                   out_col: str = "theme_display") -> DataFrame:
    """Keep the ``top_n`` most frequent values of ``column``; others, and
    rows without a value (which is no theme), become ``Other themes``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    top = (counts.orderBy(*theme_order("__n", column)).limit(top_n)
           .select(F.col(column).alias("__top")))
    j = df.join(top, F.col(column) == F.col("__top"), "left")
    return j.withColumn(out_col, F.when(F.col("__top").isNotNull(), F.col(column))
                        .otherwise(F.lit(S.OTHER_THEMES))).drop("__top")


def sentiment_by_theme(ann: DataFrame, top_n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """Top-n themes x five sentiment buckets, zero-filled, percent per theme."""
    rows = chart_theme_rows(ann).select(
        clean_label("consolidated_tag").alias("theme"),
        sentiment_bucket("sentiment").alias("sentiment"))
    in_bucket = lambda b: F.struct(F.lit(b).alias("sentiment"), F.count_if(F.col("sentiment") == b).alias("count"))
    per_theme = rows.groupBy("theme").agg(
        F.count(F.lit(1)).alias("theme_items"),
        F.array(*[in_bucket(b) for b in S.SENTIMENT_BUCKETS]).alias("__cells"))
    top = per_theme.orderBy(*theme_order("theme_items", "theme")).limit(top_n)
    out = top.select("theme", "theme_items", F.inline("__cells"))
    return out.select(
        "theme", "theme_items", "sentiment", sentiment_label("sentiment").alias("sentiment_label"),
        F.col("count"),
        (F.col("count") / F.col("theme_items") * 100).alias("percent"),
    )


def analysis_frame(ann: DataFrame) -> DataFrame:
    """Annotations for charts: cleaned theme (null/blank -> Unclustered) and
    cluster id -1 where missing."""
    return ann.withColumns({"consolidated_tag": clean_label("consolidated_tag"),
                            "cluster_id": F.coalesce(F.col("cluster_id"), F.lit(-1))})
