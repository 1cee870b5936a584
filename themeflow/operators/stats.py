"""Pipeline statistics: status counts, mean sentiment, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.functions.text import sentiment_bucket, sentiment_label


def status_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Item count by status, for posts and for comments."""
    p = posts.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("item_type", F.lit("post"))
    c = comments.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("item_type", F.lit("comment"))
    return p.unionByName(c).select("item_type", "status", "n")


def mean_sentiment(ann: DataFrame) -> DataFrame:
    """Mean raw sentiment of posts and of comments; null when none."""
    scaffold = ann.sparkSession.createDataFrame([(t,) for t in S.ITEM_TYPES], "item_type string")
    means = (ann.filter(F.col("item_type").isin(S.ITEM_TYPES))
             .groupBy("item_type").agg(F.avg("sentiment").alias("average_sentiment"),
                                       F.count(F.lit(1)).alias("n")))
    return (scaffold.join(means, "item_type", "left")
            .select("item_type", "average_sentiment", F.coalesce("n", F.lit(0)).alias("n")))


def substance_distribution(ann: DataFrame) -> DataFrame:
    """Substantive vs. reaction-only (a null flag counts as reaction-only)."""
    flag = F.coalesce(F.col("is_substantive"), F.lit(False))
    agg = ann.agg(F.count_if(flag).alias("substantive"),
                  F.count_if(~flag).alias("reaction_only"),
                  F.count(F.lit(1)).alias("total"))
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(F.lit(0.0))
    return agg.select("substantive", "reaction_only", "total",
                      pct("substantive").alias("substantive_percent"),
                      pct("reaction_only").alias("reaction_only_percent"))


def sentiment_distribution(ann: DataFrame, scope_names: dict[str, str] | None = None) -> DataFrame:
    """Counts per scope (all, post, comment) x five buckets, zero-filled, with
    percent within the scope (0.0 for an empty scope). Other item types count
    in ``all`` only.

    One pass over the items to (item_type, bucket) counts; each of these few
    rows then counts in its own scope and in ``all``."""
    names = scope_names or {"all": "all", "post": "post", "comment": "comment"}
    spark = ann.sparkSession
    cells = (ann.select(F.col("item_type"), sentiment_bucket("sentiment").alias("sentiment"))
             .groupBy("item_type", "sentiment").agg(F.count(F.lit(1)).alias("n")))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("item_type").isin(S.ITEM_TYPES), F.col("item_type"))))
    counts = (cells.select(F.explode(scopes).alias("scope"), "sentiment", "n")
              .groupBy("scope", "sentiment").agg(F.sum("n").alias("n")))
    scaffold = spark.createDataFrame(
        [(s, b) for s in ("all", "post", "comment") for b in S.SENTIMENT_BUCKETS], "scope string, sentiment double")
    j = scaffold.join(counts, ["scope", "sentiment"], "left").fillna(0, ["n"])
    j = j.withColumn("__t", F.sum("n").over(Window.partitionBy("scope")))       # fifteen rows
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return j.select(
        mapping[F.col("scope")].alias("scope"), "sentiment", sentiment_label("sentiment").alias("sentiment_label"),
        F.col("n").cast("long").alias("count"),
        F.when(F.col("__t") > 0, F.col("n") / F.col("__t") * 100).otherwise(F.lit(0.0)).alias("percent"),
    )


def unmapped_raw_tags(ann: DataFrame) -> DataFrame:
    """Distinct raw tags that have no consolidated tag yet."""
    return ann.filter(F.col("consolidated_tag").isNull()).select("raw_tag").distinct()


def consolidated_tags(ann: DataFrame, item_type: str) -> DataFrame:
    """Distinct non-empty consolidated tags of one item type."""
    return (ann.filter((F.col("item_type") == item_type) & F.col("consolidated_tag").isNotNull()
                       & (F.col("consolidated_tag") != ""))
            .select("consolidated_tag").distinct())
