"""Registered state changes (merge, resets, deletes) and exports.

Inputs are the thread bindings; the "user input" each job needs (updates,
results, id selections, tag maps) is derived by Spark from the same tables,
so every job scales with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeflow.operators import export as EX
from themeflow.operators import state as SM
from themeflow.plans import sql as Q
from themeflow.plans.registry import query
from themeflow.session import checkpoint_dir
from themeflow.sources import bindings as B
from themeflow.sources.tables import (BucketedTable, open_table, read_workspace_table, workspace_name,
                                      write_workspaces)

A = Q.ANN_COLS


def _tables(spark, sf):
    return B.thread_posts(spark, sf), B.thread_comments(spark, sf), B.thread_annotations(spark, sf)


# ----------------------------------------------------------------- upsert
def _updates(spark, sf):
    """Two writes per re-annotated comment (seq 1 then 2: the second wins)
    plus brand-new annotations for events."""
    # comments are chosen by their keys before they have their texts
    li = B.table(spark, sf, "lineitem").withColumn("l_shipday", B.comment_key()[-1])
    chosen = li.filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")).select(*B.comment_key())
    re = B.comment_annotations(spark, sf, li.join(chosen, chosen.columns, "left_semi"))
    writes = F.array(F.struct(F.lit(-1.0).alias("sentiment"), F.col("consolidated_tag"), F.lit(1).alias("seq")),
                     F.struct(F.lit(1.0).alias("sentiment"), F.upper("consolidated_tag").alias("consolidated_tag"),
                              F.lit(2).alias("seq")))
    again = re.drop("sentiment").withColumn("__w", F.explode(writes)).drop("consolidated_tag").select("*", "__w.*").drop("__w")
    ev = B.event_annotations(spark, sf).select(
        "item_id", "item_type", "sentiment", F.lit(None).cast("string").alias("summary"),
        F.col("consolidated_tag").alias("raw_tag"), F.lit(True).alias("is_substantive"),
        F.lit(None).cast("string").alias("reception_reason"), "consolidated_tag",
        F.lit(None).cast("string").alias("cluster_explanation"), F.lit(None).cast("int").alias("cluster_id"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(3).alias("seq"))
    return again.unionByName(ev)


_UPD_SQL = f"""re_ids AS (
  SELECT {Q.comment_id()} AS item_id FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O')""", f"""upd AS (
  SELECT * REPLACE (-1.0::DOUBLE AS sentiment), 1 AS seq FROM annotations WHERE item_id IN (SELECT item_id FROM re_ids)
  UNION ALL
  SELECT * REPLACE (upper(consolidated_tag) AS consolidated_tag, 1.0::DOUBLE AS sentiment), 2 AS seq
  FROM annotations WHERE item_id IN (SELECT item_id FROM re_ids)
  UNION ALL
  SELECT 'e' || event_id::VARCHAR, CASE WHEN event_type = 'click' THEN 'post' WHEN event_type = 'view' THEN 'comment'
         ELSE event_type END, value / 50 - 1, NULL, event_type, true, NULL, event_type, NULL, NULL, NULL::FLOAT[], 3
  FROM events)"""
# one window over stored rows and writes: the last write of each item stands
_UPSERT_SQL = Q.with_(Q.ANNOTATIONS.replace("annotations AS (", "annotations AS MATERIALIZED (", 1), *_UPD_SQL) + f"""
SELECT {A} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn
                 FROM (SELECT *, 0 AS seq FROM annotations UNION ALL SELECT * FROM upd)) WHERE rn = 1"""


@query("upsert_annotations", _UPSERT_SQL)
def q_upsert(spark, sf):
    return SM.upsert(B.thread_annotations(spark, sf), _updates(spark, sf), "item_id", seq="seq")


@query("merge_annotations_table", _UPSERT_SQL)
def q_merge_table(spark, sf):
    """The same writes into a stored table whose versions share the files of
    buckets that no write touches."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/merges/annotations-{uuid.uuid4().hex}"
    table = BucketedTable(spark, root, ["item_id"])
    table.write(B.thread_annotations(spark, sf))
    table.merge(SM.last_per_key(_updates(spark, sf), "item_id", "seq").drop("seq"))
    return table.read()


# ------------------------------------------------------- apply results
def _results(spark, sf):
    """Model results for the pending comments: returned items fail with a
    transient error, the others succeed with a fresh annotation."""
    c = B.thread_comments(spark, sf).filter(F.col("status") == "pending")
    li = B.table(spark, sf, "lineitem").select(B.comment_id_of().alias("item_id"), "l_returnflag", "l_discount")
    j = c.join(li, c.id == li.item_id)
    err = F.col("l_returnflag") == "R"
    return j.select(
        "item_id", F.lit("comment").alias("item_type"),
        F.when(~err, F.col("l_discount") * -10).alias("sentiment"),
        F.when(~err, F.lit("re-read")).alias("summary"),
        F.when(~err, F.lit("fresh tag")).alias("raw_tag"),
        F.when(~err, F.lit(True)).alias("is_substantive"),
        F.when(~err, F.lit("fresh reason")).alias("reception_reason"),
        F.when(err, F.lit("429 rate limit")).alias("error"))


_RES_SQL = f"""res AS (
  SELECT c.id AS item_id, 'comment' AS item_type,
         CASE WHEN l_returnflag <> 'R' THEN l_discount * -10 END AS sentiment,
         CASE WHEN l_returnflag <> 'R' THEN 're-read' END AS summary,
         CASE WHEN l_returnflag <> 'R' THEN 'fresh tag' END AS raw_tag,
         CASE WHEN l_returnflag <> 'R' THEN true END AS is_substantive,
         CASE WHEN l_returnflag <> 'R' THEN 'fresh reason' END AS reception_reason,
         CASE WHEN l_returnflag = 'R' THEN '429 rate limit' END AS error
  FROM comments c JOIN lineitem ON c.id = {Q.comment_id()} WHERE c.status = 'pending')"""


@query("apply_results_items", Q.with_(Q.COMMENTS, _RES_SQL) + """
SELECT c.id, c.post_id, c.body, c.score, c.created_utc,
       coalesce(CASE WHEN r.item_id IS NULL THEN NULL WHEN r.error IS NULL THEN 'processed' ELSE 'failed' END,
                c.status) AS status
FROM comments c LEFT JOIN res r ON c.id = r.item_id""")
def q_apply_items(spark, sf):
    items, _ = SM.apply_annotation_results(B.thread_comments(spark, sf), B.thread_annotations(spark, sf),
                                           _results(spark, sf))
    return items


@query("apply_results_annotations", Q.with_(Q.COMMENTS, Q.ANNOTATIONS, _RES_SQL) + f"""
SELECT {A} FROM annotations WHERE item_id NOT IN (SELECT item_id FROM res WHERE error IS NULL)
UNION ALL
SELECT item_id, item_type, sentiment, summary, raw_tag, is_substantive, reception_reason,
       NULL, NULL, NULL::INTEGER, NULL::FLOAT[] FROM res WHERE error IS NULL""")
def q_apply_annotations(spark, sf):
    _, ann = SM.apply_annotation_results(B.thread_comments(spark, sf), B.thread_annotations(spark, sf),
                                         _results(spark, sf))
    return ann


# ----------------------------------------------------------------- resets
@query("reset_failed_posts", Q.with_(Q.POSTS) + """
SELECT id, subreddit, title, selftext, score, created_utc,
       CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM posts""")
def q_reset_failed(spark, sf):
    return SM.reset_failed(B.thread_posts(spark, sf))


@query("reset_processed_comments", Q.with_(Q.COMMENTS, Q.ANNOTATIONS) + f"""
SELECT {A} FROM annotations WHERE item_id NOT IN (SELECT id FROM comments WHERE status = 'processed')""")
def q_reset_processed(spark, sf):
    _, ann = SM.reset_processed(B.thread_comments(spark, sf), B.thread_annotations(spark, sf))
    return ann


def _picked_ids(spark, sf):
    li = B.table(spark, sf, "lineitem").filter(F.col("l_discount") == 0.0).select(B.comment_id_of().alias("id"))
    o = B.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        B.post_id_of("o_orderkey").alias("id"))
    return li.unionByName(o).unionByName(spark.range(1).select(F.lit("no-such-id").alias("id")))


_PICKED_SQL = f"""picked AS (
  SELECT {Q.comment_id()} AS id FROM lineitem WHERE l_discount = 0.0
  UNION ALL SELECT 'o' || o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'no-such-id')"""


@query("reset_specific_annotations", Q.with_(Q.ANNOTATIONS, _PICKED_SQL) + f"""
SELECT {A} FROM annotations WHERE item_id NOT IN (SELECT id FROM picked)""")
def q_reset_specific(spark, sf):
    posts, comments, ann = _tables(spark, sf)
    return SM.reset_specific(posts, comments, ann, _picked_ids(spark, sf))[2]


@query("reset_specific_posts", Q.with_(Q.POSTS, _PICKED_SQL) + """
SELECT id, subreddit, title, selftext, score, created_utc,
       CASE WHEN id IN (SELECT id FROM picked) THEN 'pending' ELSE status END AS status FROM posts""")
def q_reset_specific_posts(spark, sf):
    posts, comments, ann = _tables(spark, sf)
    return SM.reset_specific(posts, comments, ann, _picked_ids(spark, sf))[0]


_COMMENT_COLS = "id, post_id, body, score, created_utc"


@query("reset_processed_items", Q.with_(Q.COMMENTS) + f"""
SELECT {_COMMENT_COLS}, CASE WHEN status = 'processed' THEN 'pending' ELSE status END AS status FROM comments""")
def q_reset_processed_items(spark, sf):
    return SM.reset_processed(B.thread_comments(spark, sf), B.thread_annotations(spark, sf))[0]


@query("reset_specific_comments", Q.with_(Q.COMMENTS, _PICKED_SQL) + f"""
SELECT {_COMMENT_COLS}, CASE WHEN id IN (SELECT id FROM picked) THEN 'pending' ELSE status END AS status FROM comments""")
def q_reset_specific_comments(spark, sf):
    posts, comments, ann = _tables(spark, sf)
    return SM.reset_specific(posts, comments, ann, _picked_ids(spark, sf))[1]


@query("clear_clustering", Q.with_(Q.ANNOTATIONS) + """
SELECT * REPLACE (NULL::INTEGER AS cluster_id, NULL::VARCHAR AS consolidated_tag,
                  NULL::VARCHAR AS cluster_explanation) FROM annotations""")
def q_clear(spark, sf):
    return SM.clear_clustering(B.thread_annotations(spark, sf))


TAG_MAP = {"ECONOMY": "Budget parts", "PROMO": "Promotional parts", "NO SUCH TAG": "never used"}


@query("apply_tag_mapping", Q.with_(Q.ANNOTATIONS) + """
SELECT * REPLACE (CASE raw_tag WHEN 'ECONOMY' THEN 'Budget parts' WHEN 'PROMO' THEN 'Promotional parts'
                  ELSE consolidated_tag END AS consolidated_tag) FROM annotations""")
def q_tag_map(spark, sf):
    return SM.apply_tag_mapping(B.thread_annotations(spark, sf), TAG_MAP)


@query("evolve_legacy_annotations", Q.with_(Q.ANNOTATIONS) + """
SELECT item_id, item_type, sentiment, summary, raw_tag, consolidated_tag, cluster_id, embedding,
       NULL::VARCHAR AS cluster_explanation,
       coalesce(lower(raw_tag) <> 'reaction only', true) AS is_substantive,
       CASE WHEN coalesce(lower(raw_tag) <> 'reaction only', true) THEN raw_tag END AS reception_reason
FROM annotations""")
def q_evolve(spark, sf):
    legacy = B.thread_annotations(spark, sf).drop("cluster_explanation", "is_substantive", "reception_reason")
    return SM.evolve_annotations(legacy)


def _failed_posts(spark, sf):
    return B.thread_posts(spark, sf).filter(F.col("status") == "failed").select("id")


@query("delete_failed_posts", Q.with_(Q.POSTS, Q.ANNOTATIONS) + f"""
SELECT {A} FROM annotations WHERE item_id NOT IN (SELECT id FROM posts WHERE status = 'failed')""")
def q_delete(spark, sf):
    posts = B.thread_posts(spark, sf)
    return SM.delete_items(posts, B.thread_annotations(spark, sf), _failed_posts(spark, sf))[1]


@query("delete_failed_posts_items", Q.with_(Q.POSTS) + """
SELECT id, subreddit, title, selftext, score, created_utc, status FROM posts WHERE status <> 'failed' OR status IS NULL""")
def q_delete_items(spark, sf):
    posts = B.thread_posts(spark, sf)
    return SM.delete_items(posts, B.thread_annotations(spark, sf), _failed_posts(spark, sf))[0]


@query("bulk_annotate_items", Q.with_(Q.COMMENTS, f"""sel AS (
  SELECT {Q.comment_id()} AS id FROM lineitem WHERE l_quantity = 1)""") + f"""
SELECT {_COMMENT_COLS}, CASE WHEN id IN (SELECT id FROM sel) THEN 'processed' ELSE status END AS status FROM comments""")
def q_bulk_items(spark, sf):
    sel = B.table(spark, sf, "lineitem").filter(F.col("l_quantity") == 1).select(B.comment_id_of().alias("id"))
    return SM.bulk_annotate(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), sel, "comment", 0.5, "tag",
                            True)[0]


@query("single_annotate_comments", Q.with_(Q.COMMENTS, Q.ANNOTATIONS, f"""sel AS (
  SELECT id FROM comments WHERE id IN (SELECT {Q.comment_id()} FROM lineitem WHERE l_quantity = 1))""", """old AS (
  SELECT * FROM annotations WHERE item_id NOT IN (
    SELECT {id} FROM lineitem WHERE l_linenumber = 1))""".replace("{id}", Q.comment_id())) + f"""
SELECT {A} FROM old WHERE item_id NOT IN (SELECT id FROM sel)
UNION ALL
SELECT s.id, coalesce(a.item_type, 'comment'), -0.5,
       CASE WHEN a.item_id IS NULL THEN '{SM.S.SINGLE_NEW_SUMMARY}'
            ELSE coalesce(nullif(a.summary, ''), '{SM.S.SINGLE_EDIT_SUMMARY}') END,
       'my tag', true, 'my reason', NULL, NULL, a.cluster_id, a.embedding
FROM sel s LEFT JOIN old a ON s.id = a.item_id""")
def q_single(spark, sf):
    """The single form, on items with an annotation and on new ones (those of
    first lines have none here)."""
    sel = B.table(spark, sf, "lineitem").filter(F.col("l_quantity") == 1).select(B.comment_id_of().alias("id"))
    first = B.table(spark, sf, "lineitem").filter(F.col("l_linenumber") == 1).select(B.comment_id_of().alias("item_id"))
    old = B.thread_annotations(spark, sf).join(first, "item_id", "left_anti")
    return SM.bulk_annotate(B.thread_comments(spark, sf), old, sel, "comment", -0.5, "my tag", True, "my reason",
                            bulk=False)[1]


@query("update_embeddings", Q.with_(Q.ANNOTATIONS) + """
SELECT item_id, CASE WHEN raw_tag IS NOT NULL THEN [length(raw_tag)::FLOAT, 1.0::FLOAT] END AS embedding FROM annotations""")
def q_update_embeddings(spark, sf):
    """Vectors computed for tagged rows; where the embedder failed (null) the
    old value stays."""
    ann = B.thread_annotations(spark, sf)
    results = ann.select("item_id", F.when(F.col("raw_tag").isNotNull(), F.array(
        F.length("raw_tag").cast("float"), F.lit(1.0).cast("float"))).alias("embedding"))
    return SM.update_embeddings(ann, results).select("item_id", "embedding")


@query("bulk_annotate_comments", Q.with_(Q.ANNOTATIONS, f"""sel AS (
  SELECT {Q.comment_id()} AS id FROM lineitem WHERE l_quantity = 1)""") + f"""
SELECT {A} FROM annotations WHERE item_id NOT IN (SELECT id FROM sel)
UNION ALL
SELECT a.item_id, a.item_type, 0.5, 'Bulk manually edited', 'Reaction Only', false, NULL, 'manual theme', NULL,
       a.cluster_id, a.embedding
FROM annotations a WHERE a.item_id IN (SELECT id FROM sel)""")
def q_bulk(spark, sf):
    sel = B.table(spark, sf, "lineitem").filter(F.col("l_quantity") == 1).select(B.comment_id_of().alias("id"))
    _, ann = SM.bulk_annotate(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), sel, "comment",
                              0.5, "ignored tag", False, "ignored reason", "manual theme", "")
    return ann


@query("stage2_clear_non_substantive", Q.with_(Q.ANNOTATIONS) + """
SELECT * REPLACE (CASE WHEN coalesce(is_substantive, false) THEN cluster_id END AS cluster_id,
                  CASE WHEN coalesce(is_substantive, false) THEN consolidated_tag END AS consolidated_tag,
                  CASE WHEN coalesce(is_substantive, false) THEN cluster_explanation END AS cluster_explanation)
FROM annotations""")
def q_stage2_prepare(spark, sf):
    return SM.stage2_prepare(B.thread_annotations(spark, sf))


@query("embedding_queue", Q.with_(Q.ANNOTATIONS) + """
SELECT item_id, 'Reception Reason: ' || coalesce(coalesce(nullif(reception_reason, ''), raw_tag), 'None')
       || ' | Raw Tag: ' || coalesce(raw_tag, 'None') || ' | Summary: ' || coalesce(summary, 'None') AS text
FROM annotations WHERE is_substantive AND (embedding IS NULL OR len(embedding) = 0)""")
def q_embedding_queue(spark, sf):
    return SM.embedding_queue(B.thread_annotations(spark, sf))


# ----------------------------------------------------------------- export
_COMBINED_SQL = """
SELECT 'post' AS type, p.id, NULL::VARCHAR AS parent_id, p.subreddit,
       {text} AS text, p.score, p.created_utc, a.sentiment, a.summary, a.raw_tag, a.is_substantive,
       a.reception_reason, a.consolidated_tag, a.cluster_explanation
FROM posts p JOIN annotations a ON p.id = a.item_id AND a.item_type = 'post' WHERE p.status = 'processed'
UNION ALL
SELECT 'comment', c.id, c.post_id, {sub}, c.body, c.score, c.created_utc, a.sentiment, a.summary, a.raw_tag,
       a.is_substantive, a.reception_reason, a.consolidated_tag, a.cluster_explanation
FROM comments c JOIN annotations a ON c.id = a.item_id AND a.item_type = 'comment' {join}
WHERE c.status = 'processed'"""
_TEXT = Q.strip_ws("coalesce(p.title, '') || ' ' || coalesce(p.selftext, '')")


@query("combined_items", Q.with_(Q.POSTS, Q.COMMENTS, Q.ANNOTATIONS) +
       _COMBINED_SQL.format(text=_TEXT, sub="NULL::VARCHAR", join=""))
def q_combined(spark, sf):
    return EX.combined_items(*_tables(spark, sf))


@query("combined_items_with_subreddit", Q.with_(Q.POSTS, Q.COMMENTS, Q.ANNOTATIONS) +
       _COMBINED_SQL.format(text=_TEXT, sub="pp.subreddit", join="LEFT JOIN posts pp ON c.post_id = pp.id"))
def q_combined_sub(spark, sf):
    return EX.combined_items(*_tables(spark, sf), parent_subreddit=True)


# ----------------------------------------------------------- resets of a kind
@query("reset_to_pending_annotations", Q.with_(Q.COMMENTS, Q.ANNOTATIONS, _PICKED_SQL) + f"""
SELECT {A} FROM annotations
WHERE item_id NOT IN (SELECT c.id FROM comments c WHERE c.id IN (SELECT id FROM picked))""")
def q_reset_to_pending(spark, sf):
    """A selection of comments; ids of posts in it touch nothing."""
    return SM.reset_to_pending(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), _picked_ids(spark, sf))[1]


# -------------------------------------------------------------------- layouts
def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/layouts/{name}-{uuid.uuid4().hex}"


@query("annotations_of_merged_layouts", Q.with_(Q.ANNOTATIONS) + """
SELECT item_id, item_type, sentiment, summary, raw_tag, consolidated_tag, cluster_id, embedding,
       CASE WHEN item_type = 'comment' THEN cluster_explanation END AS cluster_explanation,
       CASE WHEN item_type = 'comment' THEN is_substantive
            ELSE coalesce(lower(raw_tag) <> 'reaction only', true) END AS is_substantive,
       CASE WHEN item_type = 'comment' THEN reception_reason
            WHEN coalesce(lower(raw_tag) <> 'reaction only', true) THEN raw_tag END AS reception_reason
FROM annotations""")
def q_merged_layouts(spark, sf):
    """Posts' annotations in files of the old layout, comments' in files of
    the new one, read as one table."""
    root = _scratch(spark, "merged")
    ann = B.thread_annotations(spark, sf)
    old = ann.filter("item_type = 'post'").drop("cluster_explanation", "is_substantive", "reception_reason")
    old.write.parquet(f"{root}/annotation")
    ann.filter("item_type = 'comment'").write.mode("append").parquet(f"{root}/annotation")
    return SM.backfill_annotations(open_table(spark, root, "annotation"))


@query("workspace_posts", Q.with_(Q.POSTS) + f"""
SELECT {Q.POST_COLS}, '4-NOTSPECIFIED' AS workspace FROM posts WHERE subreddit = '4-NOT SPECIFIED'
UNION ALL SELECT {Q.POST_COLS}, '1-URGENT' FROM posts WHERE subreddit = '1-URGENT'""")
def q_workspace(spark, sf):
    """All posts stored by workspace, then two workspaces read."""
    root = _scratch(spark, "workspaces")
    write_workspaces(B.thread_posts(spark, sf), root, "subreddit")
    names = ("4-NOT SPECIFIED", "1-URGENT")
    parts = [read_workspace_table(spark, root, n).withColumn("workspace", F.lit(workspace_name(n))) for n in names]
    return parts[0].unionByName(parts[1])
