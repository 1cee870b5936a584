"""Streaming ingest, keyed upserts and windowed theme counts.

* ``ingest_stream``: payload files arriving in a folder -> post rows with
  their quality status, de-duplicated by id within a watermark on the arrival
  of the files (posts do not come in the order of their creation).
* ``upsert_batches``: ``foreachBatch`` sink merging each micro-batch into a
  versioned table; the write is named after stream and batch, so a replayed
  batch changes nothing and versions of other writers do not matter. A
  bucketed table rewrites only the buckets that the batch falls into.
* ``last_state_batches``: ``foreachBatch`` sink for changes of items; an item
  that changes leaves its old window cell, so the counts are those of the last
  state of all items.
* ``theme_counts_stream``: tumbling-window counts per theme and sentiment
  bucket with a watermark bounding the state; written in update mode into a
  keyed table, the final table equals the batch aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow.functions.text import clean_label, epoch_seconds, sentiment_bucket
from themeflow.operators.ingest import initial_status, with_defaults
from themeflow.session import materialize
from themeflow.sources import payloads as PL
from themeflow.sources.tables import BucketedTable, VersionedTable


def ingest_stream(spark: SparkSession, search_dir: str, watermark: str = "1 day") -> DataFrame:
    """Search payload files -> post rows (status by quality). A post that
    comes again within the watermark after its arrival is dropped; later
    repeats are for the keyed upsert. No post is ever too old."""
    raw = spark.readStream.schema(PL._SEARCH_FILE).json(search_dir)
    arrived = raw.withColumn("event_time", F.col("_metadata.file_modification_time"))
    posts = PL.post_candidates(PL.search_page_rows(arrived, "event_time"), "event_time")
    posts = with_defaults(posts).filter(F.col("id").isNotNull() & (F.col("id") != ""))
    posts = posts.withColumn("status", initial_status("author", "selftext"))
    return posts.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["id"])


def upsert_batches(table: VersionedTable, key: str | list[str], schema: T.StructType, stream: str = "stream",
                   skip_existing: bool = False):
    """A ``foreachBatch`` function merging each batch into ``table``.

    ``stream`` names the stream: it and the batch id are committed with the
    version. With ``skip_existing`` stored rows stay as they are and only new
    keys come in (re-ingesting a post does not reset its status)."""
    keys = [key] if isinstance(key, str) else list(key)

    def merge(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream}-{batch_id}"
        if table.holds(name):
            # committed before a restart; the batch must still be computed,
            # or the stream's state of it would be missing
            batch.write.format("noop").mode("overwrite").save()
            return
        table.merge(batch.select(*schema.fieldNames()), keys, name, skip_existing)

    return merge


CELL = ["window_start", "theme", "sentiment"]


def last_state_batches(items: BucketedTable, counts: BucketedTable, order: list[str], stream: str = "changes",
                       window: str = "1 day"):
    """A ``foreachBatch`` function for changes (item_id, ts, theme, sentiment
    and the ``order`` columns): ``items`` keeps the last change of each item,
    ``counts`` the number of items in each window cell.

    A change counts +1 in its cell and -1 in the one that the item leaves; a
    change that comes after a later one of its item is dropped. Both tables
    are keyed by name and batch, counts first, so a batch that broke off
    between them is finished, not counted twice, when it is replayed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream}-{batch_id}"
        if items.holds(name):
            batch.write.format("noop").mode("overwrite").save()
            return
        start = F.unix_micros(F.window(F.timestamp_seconds(epoch_seconds("ts")), window)["start"]) / 1e6
        cells = batch.select("item_id", F.struct(*order).alias("seq"), start.alias("window_start"),
                             clean_label(F.col("theme")).alias("theme"), sentiment_bucket(F.col("sentiment")).alias("sentiment"))
        last = cells.groupBy("item_id").agg(F.max_by(F.struct("seq", *CELL), "seq").alias("s")).select("item_id", "s.*")
        last = materialize(last, "last-changes")
        if items.latest() is None:
            items.write(last.limit(0))
            counts.write(last.select(*CELL, F.lit(0).cast("long").alias("n")).limit(0))
        old = items.touching(last).select("item_id", F.struct("seq", *CELL).alias("old"))
        moved = last.join(old, "item_id", "left").filter(F.col("old").isNull() | (F.col("seq") > F.col("old.seq")))
        moved = materialize(moved, "moved")
        enters = moved.select(*CELL, F.lit(1).cast("long").alias("n"))
        leaves = moved.filter("old IS NOT NULL").select("old.*").select(*CELL, F.lit(-1).cast("long").alias("n"))
        delta = enters.unionByName(leaves).groupBy(*CELL).agg(F.sum("n").alias("n")).filter("n <> 0")
        if not counts.holds(name):
            delta = materialize(delta, "cells")
            both = (counts.touching(delta).withColumn("new", F.lit(False))
                    .unionByName(delta.withColumn("new", F.lit(True))))
            sums = both.groupBy(*CELL).agg(F.sum("n").alias("n"), F.bool_or("new").alias("new"))
            counts.merge(sums.filter("new").drop("new"), None, name)
        items.merge(moved.drop("old"), None, name)

    return merge


def theme_counts_stream(events: DataFrame, ts_col: str, theme_col: str, sentiment_col: str,
                        window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Counts per (window, theme, sentiment bucket); late rows beyond the
    watermark are dropped by Spark, and the state for closed windows is
    released. A wall-clock (zone-less) event time is read as UTC; windows
    are reported as epoch seconds."""
    ts = F.col(ts_col)
    if isinstance(events.schema[ts_col].dataType, T.TimestampNTZType):
        ts = F.timestamp_seconds(epoch_seconds(ts_col))
    rows = events.select(ts.alias("ts"), clean_label(F.col(theme_col)).alias("theme"),
                         sentiment_bucket(F.col(sentiment_col)).alias("sentiment"))
    return (rows.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "theme", "sentiment")
            .agg(F.count(F.lit(1)).alias("n"))
            .select((F.unix_micros(F.col("w.start")) / 1e6).alias("window_start"),
                    (F.unix_micros(F.col("w.end")) / 1e6).alias("window_end"), "theme", "sentiment", "n"))


COUNT_SCHEMA = T.StructType([
    T.StructField("window_start", T.DoubleType()), T.StructField("window_end", T.DoubleType()),
    T.StructField("theme", T.StringType()), T.StructField("sentiment", T.DoubleType()),
    T.StructField("n", T.LongType()),
])


def run_available_now(df: DataFrame, checkpoint: str, foreach_batch=None, output_mode: str = "update") -> None:
    """Process everything available, then stop (restartable from the
    checkpoint)."""
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(foreach_batch).start()
    q.awaitTermination()
