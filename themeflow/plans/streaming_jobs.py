"""Registered streaming jobs: run with an ``availableNow`` trigger into a
versioned table under the session's checkpoint folder, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.plans import sql as Q
from themeflow.plans.ingestion import low_quality
from themeflow.plans.registry import query
from themeflow.session import checkpoint_dir
from themeflow.sources import bindings as B
from themeflow.sources.tables import BucketedTable
from themeflow.streaming import streams as ST


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


@query("stream_event_theme_counts", f"""
SELECT epoch(date_trunc('day', ts))::DOUBLE AS window_start,
       epoch(date_trunc('day', ts) + INTERVAL 1 DAY)::DOUBLE AS window_end,
       {Q.clean_text('event_type', S.UNCLUSTERED)} AS theme, {Q.bucket('value / 50 - 1')} AS sentiment,
       count(*) AS n
FROM events GROUP BY ALL""")
def q_stream_counts(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be one file or a folder of part files; as a
    # plain path Spark's file stream takes folders only
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    events = events.withColumn("sentiment_raw", F.col("value") / 50 - 1)
    counts = ST.theme_counts_stream(events, "ts", "event_type", "sentiment_raw")
    root = _scratch(spark, "theme-counts")
    table = BucketedTable(spark, root + "/table", ST.CELL, 8)
    ST.run_available_now(counts, root + "/checkpoint", ST.upsert_batches(table, ST.CELL, ST.COUNT_SCHEMA))
    return table.read(schema=ST.COUNT_SCHEMA)


@query("stream_ingest_posts", f"""
SELECT 'c' || conv_id::VARCHAR AS id, role AS query_id,
       CASE WHEN {low_quality("CASE WHEN role = 'system' THEN 'AutoModerator' ELSE role END", 'text')}
            THEN 'skipped' ELSE 'pending' END AS status
FROM conversations WHERE turn = 0""")
def q_stream_ingest(spark, sf):
    """Conversation openings written as search payload files (one page per
    conversation, derived by Spark), then ingested as a stream: quality
    status, de-duplication within the watermark, keyed upsert."""
    root = _scratch(spark, "ingest")
    cands = B.conversation_candidates(spark, sf)
    post = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.POST_FIELDS.fields])
    page = F.to_json(F.struct(
        F.col("query_id"), F.lit(1).alias("source_priority"), F.col("rank").cast("int").alias("page_no"),
        F.struct(F.lit(None).cast("string").alias("after"),
                 F.array(F.struct(F.lit("t3").alias("kind"), post.alias("data"))).alias("children")).alias("data")))
    cands.select(page.alias("value")).write.mode("overwrite").text(root + "/payloads")
    stream = ST.ingest_stream(spark, root + "/payloads").select(
        "id", "subreddit", "title", "selftext", "score", "created_utc", "status", "query_id")
    schema = stream.schema
    table = BucketedTable(spark, root + "/posts", ["id"], 8)
    ST.run_available_now(stream, root + "/checkpoint", ST.upsert_batches(table, "id", schema), output_mode="append")
    return table.read(schema=schema).select("id", "query_id", "status")


@query("stream_last_state_theme_counts", f"""
WITH last_state AS (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT epoch(date_trunc('day', ts))::DOUBLE AS window_start,
       {Q.clean_text('event_type', S.UNCLUSTERED)} AS theme, {Q.bucket('value / 50 - 1')} AS sentiment,
       count(*) AS n
FROM last_state GROUP BY ALL""")
def q_last_state(spark, sf):
    """Events as changes of their user's annotation, in four batches that are
    not in the order of time; users count in the cell of their last event."""
    root = _scratch(spark, "last-state")
    events = B.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("item_id"), "ts", F.col("event_type").alias("theme"),
        (F.col("value") / 50 - 1).alias("sentiment"), "event_id")
    events.repartition(4, "event_id").write.parquet(root + "/changes")
    changes = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root + "/changes")
    items = BucketedTable(spark, root + "/items", ["item_id"], 8)
    counts = BucketedTable(spark, root + "/counts", ST.CELL, 8)
    ST.run_available_now(changes, root + "/checkpoint", ST.last_state_batches(items, counts, ["ts", "event_id"]))
    return counts.read().filter("n > 0")
