"""Bind the driver's parquet tables to the item / annotation data model.

The analytics jobs take three tables (posts, comments, annotations) plus a
vector table. The test data is TPC-H-like, so each binding is a projection
(plus a join to ``part`` for theme words) that Catalyst pushes into the
parquet scans: only the columns a query uses are read.

Bindings
  threads (orders, lineitem, part)   posts = orders, comments = lineitem,
                                     annotations = both, theme words from part
  conversations                      turn 0 = post, later turns = comments
  events                             sentiment = value / 50 - 1, theme = event_type
  documents + labels                 theme = source, substantive = quality = 1
  embeddings                         vectors with a given cluster label
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.functions.text import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def post_id_of(orderkey) -> Column:
    return F.concat(F.lit("o"), _s(orderkey))


def comment_key() -> list[Column]:
    # (orderkey, linenumber, partkey, suppkey, shipdate) is unique in lineitem
    return [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.date_format("l_shipdate", "yyyyMMdd").alias("l_shipday")]


def comment_id_of() -> Column:
    """The columns of ``comment_key`` as one text; null if one of them is."""
    first, *others = [_s(c) for c in comment_key()]
    return F.concat(F.lit("l"), first, *(x for c in others for x in (F.lit("-"), c)))


# ---------------------------------------------------------------- threads

def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "processed")
              .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), "skipped")
              .when(F.col("o_orderstatus") == "O", "pending")
              .otherwise("failed"))
    return o.select(
        post_id_of("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("subreddit"),
        F.concat(F.lit("order "), _s("o_orderkey")).alias("title"),
        F.concat(F.lit("customer "), _s("o_custkey")).alias("selftext"),
        F.col("o_custkey").cast("long").alias("score"),
        epoch_seconds("o_orderdate").alias("created_utc"),
        status.alias("status"),
    )


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    status = (F.when(F.col("l_linestatus") == "F", "processed")
              .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "skipped")
              .otherwise("pending"))
    return li.select(
        comment_id_of().alias("id"),
        post_id_of("l_orderkey").alias("post_id"),
        F.concat(F.lit("line "), _s("l_linenumber"), F.lit(" of order "), _s("l_orderkey")).alias("body"),
        F.col("l_quantity").cast("long").alias("score"),
        epoch_seconds("l_shipdate").alias("created_utc"),
        status.alias("status"),
    )


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")


def thread_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per post and per comment.

    ``part`` is the dimension side of both joins; Catalyst/AQE broadcast it
    when its measured size is under the broadcast threshold and fall back to
    a shuffle join otherwise (no unconditional broadcast hint). Items without
    a part keep their annotation, without the part's words."""
    return post_annotations(spark, sf_dir).unionByName(comment_annotations(spark, sf_dir))


def comment_annotations(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Annotations of the comments, or of those in some rows of ``lineitem``."""
    part = _part_words(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    c = li.join(part, li.l_partkey == part.p_partkey, "left")
    substantive = F.col("l_returnflag") != "R"
    tag = (F.when(F.col("l_tax") == 0.0, F.lit(None).cast("string"))
           .when(F.col("l_linenumber") == 7, F.concat(F.col("p_name"), F.lit("\t")))
           .otherwise(F.col("p_name")))
    return c.select(
        comment_id_of().alias("item_id"),
        F.lit("comment").alias("item_type"),
        (F.col("l_discount") * 20 - 1).alias("sentiment"),
        F.concat_ws(" ", "p_brand", "p_type").alias("summary"),
        F.col("p_type").alias("raw_tag"),
        substantive.alias("is_substantive"),
        F.when(substantive, F.col("p_type")).alias("reception_reason"),
        tag.alias("consolidated_tag"),
        F.when(F.col("l_tax") != 0.01, F.concat(F.lit("because "), F.col("p_brand"))).alias("cluster_explanation"),
        F.when(tag.isNotNull(), F.col("p_size")).cast("int").alias("cluster_id"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def post_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part_words(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    p = o.join(part, o.o_custkey == part.p_partkey, "left")
    p_subst = F.col("o_orderstatus") != "P"
    return p.select(
        post_id_of("o_orderkey").alias("item_id"),
        F.lit("post").alias("item_type"),
        ((F.col("o_custkey") % 9 - 4) / F.lit(4.0)).alias("sentiment"),
        F.concat_ws(" ", "p_brand", "p_type").alias("summary"),
        F.when(p_subst, F.col("p_type")).otherwise(F.lit("Reaction Only")).alias("raw_tag"),
        p_subst.alias("is_substantive"),
        F.when(p_subst, F.col("p_type")).alias("reception_reason"),
        F.col("p_name").alias("consolidated_tag"),
        F.concat(F.lit("because "), F.col("p_brand")).alias("cluster_explanation"),
        F.col("p_size").cast("int").alias("cluster_id"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


# ---------------------------------------------------------- conversations

def conversation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw post candidates of the ingest jobs: one per conversation (turn 0).

    ``query_id`` = role of the opening turn, ``rank`` = conversation id (the
    search order), ``author`` = role, where system turns play the moderator,
    ``score`` = text length, one minute between conversations from Nov 2023."""
    cv = table(spark, sf_dir, "conversations").filter(F.col("turn") == 0)
    return cv.select(
        F.col("role").alias("query_id"),
        F.col("conv_id").alias("rank"),
        F.concat(F.lit("c"), _s("conv_id")).alias("id"),
        F.col("role").alias("subreddit"),
        F.col("text").alias("title"),
        F.col("text").alias("selftext"),
        F.when(F.col("role") == "system", F.lit("AutoModerator")).otherwise(F.col("role")).alias("author"),
        F.length("text").cast("long").alias("score"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 60).cast("double").alias("created_utc"),
    )


def conversation_comment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw comment candidates: later turns, in turn order within a thread."""
    cv = table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)
    return cv.select(
        F.concat(F.lit("c"), _s("conv_id")).alias("post_id"),
        F.col("turn").alias("pos"),
        F.lit("t1").alias("kind"),
        F.concat(F.lit("c"), _s("conv_id"), F.lit("-"), _s("turn")).alias("id"),
        F.col("text").alias("body"),
        F.when(F.col("role") == "system", F.lit("AutoModerator")).otherwise(F.col("role")).alias("author"),
        F.col("turn").cast("long").alias("score"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")).cast("double").alias("created_utc"),
    )


def conversation_stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts "stored by an earlier run": conversations with more than three turns."""
    cv = table(spark, sf_dir, "conversations")
    return (cv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 3)
            .select(F.concat(F.lit("c"), _s("conv_id")).alias("id")))


# ----------------------------------------------------------------- events

def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("e"), _s("event_id")).alias("item_id"),
        F.when(F.col("event_type") == "click", "post")
         .when(F.col("event_type") == "view", "comment")
         .otherwise(F.col("event_type")).alias("item_type"),
        (F.col("value") / 50 - 1).alias("sentiment"),
        F.col("event_type").alias("consolidated_tag"),
        F.col("ts"),
        F.col("props"),
    )


# -------------------------------------------------------------- documents

def document_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotations. Unlabelled documents have a null flag."""
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    j = d.join(lb, "doc_id", "left")
    return j.select(
        F.concat(F.lit("d"), _s("doc_id")).alias("item_id"),
        F.col("lang").alias("item_type"),
        F.col("text").alias("summary"),
        F.col("source").alias("raw_tag"),
        (F.col("quality") == 1).alias("is_substantive"),
        F.col("source").alias("consolidated_tag"),
        F.col("text").alias("cluster_explanation"),
    )


# ------------------------------------------------------------- embeddings

def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a given clustering: the table label, noise (-1) for every
    seventh vector id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("v"), _s("vec_id")).alias("item_id"),
        F.col("vec_id"),
        F.col("embedding"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster_id"),
    )


def vector_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as substantive annotations: texts from the document with the
    same id (left join; vectors without a document keep null texts)."""
    v = vector_table(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    j = v.join(d, v.vec_id == d.doc_id, "left")
    return j.select(
        "item_id", "vec_id", "embedding", "cluster_id",
        F.col("source").alias("reception_reason"),
        F.coalesce(F.col("lang"), F.lit("unlabelled")).alias("raw_tag"),
        F.col("text").alias("summary"),
        F.lit(True).alias("is_substantive"),
    )
