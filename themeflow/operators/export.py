"""Combined item export: annotated posts and comments in one layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.functions.text import trimmed_concat

COMBINED_COLUMNS = ["type", "id", "parent_id", "subreddit", "text", "score", "created_utc", "sentiment",
                    "summary", "raw_tag", "is_substantive", "reception_reason", "consolidated_tag",
                    "cluster_explanation"]

_ANN_COLS = ["sentiment", "summary", "raw_tag", "is_substantive", "reception_reason", "consolidated_tag",
             "cluster_explanation"]


def _annotated(items: DataFrame, annotations: DataFrame, item_type: str) -> DataFrame:
    """Processed items of one kind joined to their annotation of that kind.
    Both sides are item-sized and keyed by a primary key: a shuffle (or
    co-partitioned) equi-join without skew."""
    a = annotations.filter(F.col("item_type") == item_type).select("item_id", *_ANN_COLS)
    return items.filter(F.col("status") == "processed").join(a, items.id == a.item_id, "inner")


def combined_items(posts: DataFrame, comments: DataFrame, annotations: DataFrame,
                   parent_subreddit: bool = False) -> DataFrame:
    """Union of annotated posts (text = title + ' ' + body, stripped) and
    comments (parent = post id). With ``parent_subreddit`` comments take the
    community of their post through one more join."""
    p = _annotated(posts, annotations, "post").select(
        F.lit("post").alias("type"), "id", F.lit(None).cast("string").alias("parent_id"), "subreddit",
        trimmed_concat("title", "selftext").alias("text"), "score", "created_utc", *_ANN_COLS)
    c = _annotated(comments, annotations, "comment")
    if parent_subreddit:
        parents = posts.select(F.col("id").alias("__pid"), F.col("subreddit").alias("__sub"))
        c = c.join(parents, c.post_id == parents.__pid, "left")
        sub = F.col("__sub")
    else:
        sub = F.lit(None).cast("string")
    c = c.select(F.lit("comment").alias("type"), "id", F.col("post_id").alias("parent_id"),
                 sub.alias("subreddit"), F.col("body").alias("text"), "score", "created_utc", *_ANN_COLS)
    return p.unionByName(c).select(*COMBINED_COLUMNS)


def comments_with_subreddit(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments enriched with their post's community (left join)."""
    parents = posts.select(F.col("id").alias("__pid"), F.col("subreddit"))
    return (comments.join(parents, comments.post_id == parents.__pid, "left")
            .drop("__pid"))
