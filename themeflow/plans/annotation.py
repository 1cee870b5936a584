"""Registered annotation jobs: model responses built from ``conversations``
are parsed and normalised natively; the oracle derives the expected fields
straight from the source columns (no JSON), so it checks the whole parse."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from themeflow.operators import annotate as AN
from themeflow.schemas import ANNOTATIONS
from themeflow.operators import state as SM
from themeflow.plans import sql as Q
from themeflow.plans.registry import query
from themeflow.sources import bindings as B


def responses(spark, sf):
    """One response per turn. user: flag and reason absent-ish, tag ' Reaction
    Only '; assistant: flag "yes", reason absent; system: flag false, tag
    'off topic'. Even turns come fenced; every eleventh conversation lacks a
    summary (a validation failure)."""
    cv = B.table(spark, sf, "conversations")
    role = F.col("role")
    sent = (F.col("turn") % 5 - 2) * 0.3
    fields = F.when(role == "user", F.to_json(F.struct(
                sent.alias("sentiment"), F.col("text").alias("summary"),
                F.lit(" Reaction Only ").alias("raw_tag"), F.lit(None).cast("string").alias("reception_reason")),
                {"ignoreNullFields": "false"}))
    fields = fields.when(role == "assistant", F.to_json(F.struct(
                sent.alias("sentiment"), F.col("text").alias("summary"),
                F.lit("helpful answer").alias("raw_tag"), F.lit("yes").alias("is_substantive"))))
    fields = fields.otherwise(F.to_json(F.struct(
                sent.alias("sentiment"), F.col("text").alias("summary"),
                F.lit("off topic").alias("raw_tag"), F.lit(False).alias("is_substantive"))))
    no_summary = F.regexp_replace(fields, r'"summary":".*?(?<!\\)","raw_tag"', '"raw_tag"')
    body = F.when(F.col("conv_id") % 11 == 0, no_summary).otherwise(fields)
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return cv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                              F.col("turn").cast("string")).alias("item_id"),
                     F.when(F.col("turn") == 0, "post").otherwise("comment").alias("item_type"),
                     fenced.alias("response"), F.lit(None).cast("string").alias("error"))


_PARSE_SQL = f"""
SELECT 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR AS item_id,
       CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS item_type,
       CASE WHEN conv_id % 11 <> 0 THEN {Q.bucket('(turn % 5 - 2) * 0.3')} END AS sentiment,
       CASE WHEN conv_id % 11 <> 0 THEN text END AS summary,
       CASE WHEN conv_id % 11 <> 0 THEN CASE role WHEN 'assistant' THEN 'helpful answer'
            WHEN 'system' THEN 'Off Topic' ELSE 'Reaction Only' END END AS raw_tag,
       CASE WHEN conv_id % 11 <> 0 THEN role = 'assistant' END AS is_substantive,
       CASE WHEN conv_id % 11 <> 0 AND role = 'assistant' THEN 'helpful answer' END AS reception_reason,
       CASE WHEN conv_id % 11 = 0 THEN 'summary must be a string' END AS error
FROM conversations"""


@query("parse_model_responses", _PARSE_SQL)
def q_parse(spark, sf):
    return AN.parse_item_responses(responses(spark, sf))


def echo_model(texts: list[str]) -> list[str]:
    """Deterministic stand-in model used by the registered job: the reaction
    of a text is positive when it is long. A user injects a real client."""
    out = []
    for t in texts:
        n = len(t)
        out.append(json.dumps({"sentiment": 1.0 if n > 200 else -0.5, "summary": t,
                               "raw_tag": "long reply" if n > 200 else "reaction only"}))
    return out


def _threads(spark, sf):
    """Conversations as pending posts and comments; missing texts are empty,
    as in the ingest jobs."""
    posts = B.conversation_candidates(spark, sf).select(
        "id", "subreddit", "title", "selftext", "score", "created_utc", F.lit("pending").alias("status"))
    comments = B.conversation_comment_candidates(spark, sf).select(
        "id", "post_id", "body", "score", "created_utc", F.lit("pending").alias("status"))
    return posts.fillna("", ["title", "selftext"]), comments.fillna("", ["body"])


_INPUTS_SQL = """inputs AS (
  SELECT 'c' || conv_id::VARCHAR AS item_id, 'post' AS item_type,
         'Title: ' || coalesce(text, '') || chr(10) || chr(10) || 'Body: ' || coalesce(text, '') AS text
  FROM conversations WHERE turn = 0
  UNION ALL
  SELECT 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR, 'comment', coalesce(text, '') FROM conversations WHERE turn > 0)"""


@query("annotate_threads", Q.with_(_INPUTS_SQL) + """
SELECT item_id, item_type, CASE WHEN length(text) > 200 THEN 1.0 ELSE -0.5 END::DOUBLE AS sentiment, text AS summary,
       CASE WHEN length(text) > 200 THEN 'long reply' ELSE 'Reaction Only' END AS raw_tag,
       length(text) > 200 AS is_substantive, CASE WHEN length(text) > 200 THEN 'long reply' END AS reception_reason,
       NULL::VARCHAR AS consolidated_tag, NULL::VARCHAR AS cluster_explanation,
       NULL::INTEGER AS cluster_id, NULL::FLOAT[] AS embedding FROM inputs""")
def q_annotate(spark, sf):
    """Queue -> model in rounds -> parse -> merge into items/annotations.
    Returns the new annotations of the conversation threads."""
    posts, comments = _threads(spark, sf)
    parsed = AN.annotate_items(posts, comments, echo_model)
    _, new_ann = SM.apply_annotation_results(comments, spark.createDataFrame([], ANNOTATIONS), parsed)
    return new_ann


def limited_model(texts: list[str], target_subject: str = "") -> list[str]:
    """A stand-in that never answers texts of certain lengths, and answers
    the others with the subject."""
    if any(len(t) % 14 == 7 for t in texts):
        raise RuntimeError("429 rate limit")
    if any(len(t) % 14 == 0 for t in texts):
        raise RuntimeError("no such model")
    return [json.dumps({"sentiment": 0, "summary": f"on {target_subject}", "raw_tag": "reply"}) for _ in texts]


@query("annotate_threads_in_rounds", Q.with_(_INPUTS_SQL) + """
SELECT item_id, item_type, CASE WHEN length(text) % 7 <> 0 THEN 0.0 END::DOUBLE AS sentiment,
       CASE WHEN length(text) % 7 <> 0 THEN 'on the finale' END AS summary,
       CASE WHEN length(text) % 7 <> 0 THEN 'reply' END AS raw_tag,
       CASE WHEN length(text) % 7 <> 0 THEN true END AS is_substantive,
       CASE WHEN length(text) % 7 <> 0 THEN 'reply' END AS reception_reason,
       CASE WHEN length(text) % 14 = 7 THEN 'RuntimeError: 429 rate limit'
            WHEN length(text) % 14 = 0 THEN 'RuntimeError: no such model' END AS error,
       CASE WHEN length(text) % 14 = 7 THEN 3 ELSE 1 END::INTEGER AS attempts, 'the finale' AS target_subject
FROM inputs""")
def q_rounds(spark, sf):
    """A target subject, calls that fail for good, and calls that fail for a
    passing reason until no attempt is left."""
    return AN.annotate_items(*_threads(spark, sf), limited_model, target_subject="the finale")
