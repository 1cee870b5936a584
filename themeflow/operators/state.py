"""Table state changes as pure DataFrame -> DataFrame functions.

Parquet has no UPDATE, so every change returns the new table; callers write
it as a new version (``sources.tables``). Keys are primary keys, so joins on
them are not skewed; a hot key can only appear in the update side, which is
reduced per key with a partial aggregate before any join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeflow import schemas as S


def _ids_frame(spark, ids, name: str = "__id") -> DataFrame:
    """Ids from a Python list or a DataFrame with one column. Spark chooses
    the join by their size."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("string").alias(name)).distinct()
    ids = sorted({str(i) for i in ids})
    return spark.createDataFrame([(i,) for i in ids], f"{name} string")


def _first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``: a partial limit of one row per key
    and map task comes before the shuffle, so a key repeated millions of
    times costs little."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def last_per_key(updates: DataFrame, key: str | list[str], seq: str | None = None) -> DataFrame:
    """Last write per key: the row with the largest ``seq`` (ties: any
    equal-seq row is a valid last write; pass a unique seq to pin it)."""
    keys = [key] if isinstance(key, str) else list(key)
    return updates.dropDuplicates(keys) if seq is None else _first_row(updates, keys, [F.col(seq).desc()])


def first_of_dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``, sorted after the shuffle alone: for
    rows whose keys hardly repeat, where a limit before the shuffle would sort
    (and spill) all rows and drop none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.lag(F.lit(True)).over(w).isNull()).filter("__first").drop("__first")


def stored_and_new(base: DataFrame, updates: DataFrame, keys: list[str], seq: str | None = None) -> tuple[DataFrame, list[Column]]:
    """Stored rows and one write per key, and the order in which the row that
    stands comes first."""
    new = updates.withColumn("__seq", F.col(seq).cast("long") if seq else F.lit(0).cast("long")).withColumn("__new", F.lit(1))
    old = base.withColumn("__seq", F.lit(0).cast("long")).withColumn("__new", F.lit(0))
    both = old.unionByName(new.select(*base.columns, "__seq", "__new"))
    return both, [F.col("__new").desc(), F.col("__seq").desc()]


def upsert(base: DataFrame, updates: DataFrame, key: str | list[str], seq: str | None = None) -> DataFrame:
    """Insert or fully overwrite rows by key (nulls in the update win). The
    writes are reduced per key first (a key may be written millions of times);
    then old and new rows go through one shuffle, updates before the stored row."""
    keys = [key] if isinstance(key, str) else list(key)
    updates = _first_row(updates, keys, [F.col(seq).cast("long").desc() if seq else F.lit(0).desc()])
    both, order = stored_and_new(base, updates, keys, seq)
    return first_of_dealt(both, keys, order).select(*base.columns)


def apply_annotation_results(items: DataFrame, annotations: DataFrame, results: DataFrame,
                             item_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge model results into items and annotations.

    ``results`` has ``item_id``, the annotation columns and ``error``. A row
    without error upserts its annotation and marks the item ``processed``; a
    row with error marks the item ``failed`` and leaves its annotation alone.
    Results for unknown items still upsert their annotation. With
    ``item_type`` only results of that type touch ``items`` (a post's result
    says nothing of a comment with the same id).

    Both outputs read ``results``: pass a stored frame (``materialize``) if
    computing it calls a model. Of several results of an item a success wins."""
    by_type = "item_type" in results.columns
    if item_type is not None and by_type:
        results = results.filter(F.col("item_type") == item_type)
    res = _first_row(results, ["item_id"], [F.col("error").isNull().desc()] + [
        F.col(c).asc_nulls_last() for c in ("sentiment", "raw_tag", "summary") if c in results.columns])
    ok = res.filter(F.col("error").isNull())
    upd = ok.select(*[F.col(c) if c in ok.columns else F.lit(None).cast(annotations.schema[c].dataType).alias(c)
                      for c in annotations.columns])
    new_ann = upsert(annotations, upd, "item_id")
    verdict = res.select(F.col("item_id").alias("id"),
                         F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("__status"))
    new_items = (items.join(verdict, "id", "left")
                 .withColumn("status", F.coalesce(F.col("__status"), F.col("status")))
                 .drop("__status").select(*items.columns))
    return new_items, new_ann


def reset_failed(items: DataFrame) -> DataFrame:
    """failed -> pending; annotations are kept."""
    return items.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def reset_processed(items: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """processed -> pending and their annotations removed."""
    done = items.filter(F.col("status") == "processed").select(F.col("id").alias("item_id"))
    new_items = items.withColumn(
        "status", F.when(F.col("status") == "processed", "pending").otherwise(F.col("status")))
    return new_items, annotations.join(done, "item_id", "left_anti")


def reset_specific(posts: DataFrame, comments: DataFrame, annotations: DataFrame, ids) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Given ids (posts and/or comments) -> pending, their annotations removed.
    Unknown ids are ignored."""
    sel = _ids_frame(posts.sparkSession, ids)
    hit = (posts.select("id").unionByName(comments.select("id"))
           .join(sel, F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("item_id")))

    def to_pending(items):
        j = items.join(sel, F.col("id") == F.col("__id"), "left")
        return j.withColumn("status", F.when(F.col("__id").isNotNull(), "pending").otherwise(F.col("status"))) \
                .select(*items.columns)
    return to_pending(posts), to_pending(comments), annotations.join(hit, "item_id", "left_anti")


def reset_to_pending(items: DataFrame, annotations: DataFrame, ids) -> tuple[DataFrame, DataFrame]:
    """Reset a selection of one item kind to pending and drop annotations."""
    sel = _ids_frame(items.sparkSession, ids)
    j = items.join(sel, F.col("id") == F.col("__id"), "left")
    new_items = j.withColumn("status", F.when(F.col("__id").isNotNull(), "pending")
                             .otherwise(F.col("status"))).select(*items.columns)
    hit = items.join(sel, F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("item_id"))
    return new_items, annotations.join(hit, "item_id", "left_anti")


def clear_clustering(annotations: DataFrame) -> DataFrame:
    """Drop cluster id, consolidated tag and explanation (embedding kept)."""
    return annotations.withColumns({
        "cluster_id": F.lit(None).cast("int"),
        "consolidated_tag": F.lit(None).cast("string"),
        "cluster_explanation": F.lit(None).cast("string"),
    })


def apply_tag_mapping(annotations: DataFrame, mapping) -> DataFrame:
    """Every annotation whose raw tag is a key gets the mapped tag."""
    spark = annotations.sparkSession
    if isinstance(mapping, Mapping):
        m = spark.createDataFrame(sorted(mapping.items()), "__raw string, __mapped string")
    else:
        m = mapping.toDF("__raw", "__mapped").dropDuplicates(["__raw"])
    j = annotations.join(m, F.col("raw_tag") == F.col("__raw"), "left")
    return (j.withColumn("consolidated_tag", F.when(F.col("__raw").isNotNull(), F.col("__mapped"))
                         .otherwise(F.col("consolidated_tag")))
            .select(*annotations.columns))


def evolve_annotations(annotations: DataFrame) -> DataFrame:
    """Add the late columns to an old layout, with the back-fill rules."""
    out = annotations
    cols = set(out.columns)
    if "cluster_explanation" not in cols:
        out = out.withColumn("cluster_explanation", F.lit(None).cast("string"))
    if "is_substantive" not in cols:
        out = out.withColumn("is_substantive",
                             F.coalesce(F.lower(F.col("raw_tag")) != "reaction only", F.lit(True)))
    if "reception_reason" not in cols:
        out = out.withColumn("reception_reason",
                             F.when(F.col("is_substantive"), F.col("raw_tag")).cast("string"))
    return out


def backfill_annotations(merged: DataFrame) -> DataFrame:
    """Rows of several layouts read as one (``tables.open_table``): those
    without a flag get it, and their reason, by the back-fill rules."""
    ann = evolve_annotations(merged)
    old = F.col("is_substantive").isNull()
    flag = F.coalesce("is_substantive", F.lower("raw_tag") != "reaction only", F.lit(True))
    return ann.withColumns({"is_substantive": flag, "reception_reason": F.when(old & flag, F.col("raw_tag")).otherwise(
        F.when(~old, F.col("reception_reason")))})


def delete_items(items: DataFrame, annotations: DataFrame, ids) -> tuple[DataFrame, DataFrame]:
    """Delete items and their annotations (child comments stay)."""
    sel = _ids_frame(items.sparkSession, ids)
    return (items.join(sel, F.col("id") == F.col("__id"), "left_anti"),
            annotations.join(sel, F.col("item_id") == F.col("__id"), "left_anti"))


def bulk_annotate(items: DataFrame, annotations: DataFrame, ids, item_type: str, sentiment: float,
                  raw_tag: str | None, is_substantive: bool, reception_reason: str | None = None,
                  theme: str | None = None, explanation: str | None = None,
                  bulk: bool = True) -> tuple[DataFrame, DataFrame]:
    """Same manual annotation on all selected items (create or overwrite).

    Empty tag -> ``Reaction Only``; not substantive -> tag ``Reaction Only``
    and no reason; empty reason/theme/explanation -> null. New rows get a
    fixed summary; existing rows get the bulk edit text (bulk form) or keep
    theirs (single-item form). Existing rows keep item type, embedding and
    cluster id. Selected items become ``processed``."""
    sel = _ids_frame(items.sparkSession, ids)
    chosen = items.join(sel, F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("item_id"))
    tag = raw_tag or S.REACTION_ONLY
    reason = reception_reason or ""
    if not is_substantive:
        tag, reason = S.REACTION_ONLY, ""
    # stored rows and chosen ids through one shuffle: a chosen id edits the row that it meets
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in annotations.schema if f.name != "item_id"]
    both = (annotations.withColumns({"__old": F.lit(1), "__sel": F.lit(0)})
            .unionByName(chosen.filter(F.col("item_id").isNotNull())
                         .select("item_id", *none, F.lit(0).alias("__old"), F.lit(1).alias("__sel"))))
    order = [F.col("__old").desc()]
    whole = Window.partitionBy("item_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("__chosen", F.max("__sel").over(whole) == 1)
    both = first_of_dealt(both, ["item_id"], order)
    exists = F.col("__old") == 1
    if bulk:
        summary = F.when(exists, F.lit(S.BULK_EDIT_SUMMARY)).otherwise(F.lit(S.BULK_NEW_SUMMARY))
    else:
        summary = F.when(exists, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit(S.SINGLE_EDIT_SUMMARY))) \
                   .otherwise(F.lit(S.SINGLE_NEW_SUMMARY))
    edits = {
        "item_type": F.when(exists, F.col("item_type")).otherwise(F.lit(item_type)),
        "sentiment": F.lit(float(sentiment)),
        "summary": summary,
        "raw_tag": F.lit(tag),
        "is_substantive": F.lit(bool(is_substantive)),
        "reception_reason": F.lit(reason or None).cast("string"),
        "consolidated_tag": F.lit(theme or None).cast("string"),
        "cluster_explanation": F.lit(explanation or None).cast("string"),
    }
    new_ann = both.select(*[F.when(F.col("__chosen"), edits[c]).otherwise(F.col(c)).alias(c) if c in edits else F.col(c)
                            for c in annotations.columns])
    j2 = items.join(sel, F.col("id") == F.col("__id"), "left")
    new_items = j2.withColumn("status", F.when(F.col("__id").isNotNull(), "processed")
                              .otherwise(F.col("status"))).select(*items.columns)
    return new_items, new_ann


def update_embeddings(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """Cache-aware vector update: a result with a vector replaces the old one,
    a failed result (null vector) keeps it."""
    r = last_per_key(results.select("item_id", F.col("embedding").alias("__new")), "item_id")
    j = annotations.join(r, "item_id", "left")
    return j.withColumn("embedding", F.coalesce(F.col("__new"), F.col("embedding"))).select(*annotations.columns)


def stage2_prepare(annotations: DataFrame) -> DataFrame:
    """Non-substantive annotations lose cluster id, tag and explanation."""
    keep = F.coalesce(F.col("is_substantive"), F.lit(False))
    return annotations.withColumns({
        "cluster_id": F.when(keep, F.col("cluster_id")),
        "consolidated_tag": F.when(keep, F.col("consolidated_tag")),
        "cluster_explanation": F.when(keep, F.col("cluster_explanation")),
    })


def embedding_queue(annotations: DataFrame, force: bool = False) -> DataFrame:
    """Substantive annotations that need a vector, with the text to embed.
    ``reason or tag``: a null or empty reason falls through to the tag."""
    subst = annotations.filter(F.col("is_substantive") == F.lit(True))
    need = subst if force else subst.filter(F.col("embedding").isNull() | (F.size("embedding") == 0))
    reason = F.coalesce(F.nullif(F.col("reception_reason"), F.lit("")), F.col("raw_tag"))
    text = F.format_string("Reception Reason: %s | Raw Tag: %s | Summary: %s",
                           _pytext(reason), _pytext(F.col("raw_tag")), _pytext(F.col("summary")))
    return need.select("item_id", text.alias("text"))


def _pytext(c: Column) -> Column:
    """How a Python f-string renders a nullable string: null -> 'None'."""
    return F.coalesce(c, F.lit("None"))
