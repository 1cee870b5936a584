"""Registered ingest jobs and search filters over the conversation binding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators import filters as FL
from themeflow.operators import ingest as IN
from themeflow.operators.text_index import TextIndex
from themeflow.plans import sql as Q
from themeflow.plans.registry import query
from themeflow.session import checkpoint_dir
from themeflow.sources import bindings as B
from themeflow.sources import payloads as PL

POST_LIMIT = 50
COMMENT_LIMIT = 3

CANDS = """cands AS (
  SELECT role AS query_id, conv_id AS rank, 'c' || conv_id::VARCHAR AS id, role AS subreddit, text AS title,
         text AS selftext, CASE WHEN role = 'system' THEN 'AutoModerator' ELSE role END AS author,
         length(text)::BIGINT AS score, (1700000000 + conv_id * 60)::DOUBLE AS created_utc
  FROM conversations WHERE turn = 0)"""
STORED = """stored AS (
  SELECT 'c' || conv_id::VARCHAR AS id FROM conversations GROUP BY conv_id HAVING count(*) > 3)"""


def low_quality(author: str, body: str) -> str:
    a, b = f"lower(coalesce({author}, ''))", f"lower(coalesce({body}, ''))"
    return f"({a} = 'automoderator' OR contains({a}, 'bot') OR {b} IN ('[deleted]', '[removed]', ''))"


def _kept_sql(order: str, fill: bool = True, skip_existing: bool = True) -> tuple[str, ...]:
    page = (f"""paged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pn
  FROM cands) WHERE pn <= {POST_LIMIT})""" if not fill else "paged AS (SELECT * FROM cands)")
    return (CANDS, STORED, page, f"""firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY {order}) AS rn FROM paged
                 WHERE id IS NOT NULL AND id <> '') WHERE rn = 1)""",
            f"""fresh AS (SELECT * FROM firsts {"WHERE id NOT IN (SELECT id FROM stored)" if skip_existing else ""})""",
            f"""st AS (SELECT *, CASE WHEN {low_quality('author', 'selftext')} THEN 'skipped' ELSE 'pending' END AS status
  FROM fresh)""", f"""q AS (
  SELECT *, coalesce(sum(CASE WHEN status <> 'skipped' THEN 1 ELSE 0 END) OVER (
           PARTITION BY query_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM st)""", f"""kept AS (SELECT * FROM q {f"WHERE before < {POST_LIMIT}" if fill else ""})""")


_OUT = "SELECT id, subreddit, title, selftext, score, created_utc, status, query_id FROM kept"


def _kept(spark, sf, sort="relevance", fill=True, skip_existing=True):
    cands = B.conversation_candidates(spark, sf)
    stored = B.conversation_stored_posts(spark, sf)
    return IN.ingest_posts(cands, stored, POST_LIMIT, fill_post_limit=fill, skip_existing=skip_existing,
                           order=IN.search_order(sort))


def _post_out(df):
    return df.select("id", "subreddit", "title", "selftext", "score", "created_utc", "status", "query_id")


@query("ingest_posts", Q.with_(*_kept_sql("rank, id")) + _OUT)
def q_ingest_posts(spark, sf):
    return _post_out(_kept(spark, sf))


@query("ingest_posts_top", Q.with_(*_kept_sql("score DESC, rank, id")) + _OUT)
def q_ingest_posts_top(spark, sf):
    return _post_out(_kept(spark, sf, sort="top"))


@query("ingest_posts_one_page", Q.with_(*_kept_sql("rank, id", fill=False, skip_existing=False)) + _OUT)
def q_ingest_posts_page(spark, sf):
    return _post_out(_kept(spark, sf, fill=False, skip_existing=False))


@query("ingest_comments", Q.with_(*_kept_sql("rank, id"), f"""cc AS (
  SELECT 'c' || conv_id::VARCHAR AS post_id, turn AS pos, 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
         text AS body, CASE WHEN role = 'system' THEN 'AutoModerator' ELSE role END AS author,
         turn::BIGINT AS score, (1700000000 + conv_id * 60 + turn)::DOUBLE AS created_utc
  FROM conversations WHERE turn > 0)""", f"""capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos, id) AS rn FROM cc
                 WHERE post_id IN (SELECT id FROM kept)) WHERE rn <= {COMMENT_LIMIT})""") + f"""
SELECT id, post_id, body, score, created_utc,
       CASE WHEN {low_quality('author', 'body')} THEN 'skipped' ELSE 'pending' END AS status FROM capped""")
def q_ingest_comments(spark, sf):
    kept = _kept(spark, sf)
    c = IN.ingest_comments(B.conversation_comment_candidates(spark, sf), kept, COMMENT_LIMIT)
    return IN.to_comment_rows(c)


@query("ingest_comments_by_score", Q.with_(*_kept_sql("rank, id"), """cc AS (
  SELECT 'c' || conv_id::VARCHAR AS post_id, turn AS pos, 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
         text AS body, CASE WHEN role = 'system' THEN 'AutoModerator' ELSE role END AS author,
         turn::BIGINT AS score, (1700000000 + conv_id * 60 + turn)::DOUBLE AS created_utc
  FROM conversations WHERE turn > 0)""", f"""capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, pos, id) AS rn FROM cc
                 WHERE post_id IN (SELECT id FROM kept)) WHERE rn <= {COMMENT_LIMIT})""") + f"""
SELECT id, post_id, body, score, created_utc,
       CASE WHEN {low_quality('author', 'body')} THEN 'skipped' ELSE 'pending' END AS status FROM capped""")
def q_ingest_comments_by_score(spark, sf):
    """The order of archive layouts: best score first."""
    c = IN.ingest_comments(B.conversation_comment_candidates(spark, sf), _kept(spark, sf), COMMENT_LIMIT,
                           order=IN.ARCHIVE_ORDER)
    return IN.to_comment_rows(c)


@query("ingest_posts_new", Q.with_(*_kept_sql("created_utc DESC, rank, id")) + _OUT)
def q_ingest_posts_new(spark, sf):
    return _post_out(_kept(spark, sf, sort="new"))


@query("ingest_counters", Q.with_(*_kept_sql("rank, id"), """ex AS (
  SELECT query_id, count(*) AS skipped_existing FROM firsts WHERE id IN (SELECT id FROM stored) GROUP BY query_id)""",
                                   """ad AS (
  SELECT query_id, count(*) AS added, count(*) FILTER (WHERE status <> 'skipped') AS usable
  FROM kept GROUP BY query_id)""") + """
SELECT coalesce(ad.query_id, ex.query_id) AS query_id, coalesce(added, 0) AS added, coalesce(usable, 0) AS usable,
       coalesce(skipped_existing, 0) AS skipped_existing FROM ad FULL JOIN ex ON ad.query_id = ex.query_id""")
def q_ingest_counters(spark, sf):
    cands = B.conversation_candidates(spark, sf)
    stored = B.conversation_stored_posts(spark, sf)
    return IN.ingest_counters(cands, stored, _kept(spark, sf))


SEARCH = dict(all_of=["le"], any_of=["eau", "ou"], none_of=["xyz", "vi"])


def _search_sql() -> str:
    hay = "lower(concat_ws(' ', coalesce(title, ''), coalesce(selftext, '')))"
    parts = [f"contains({hay}, '{t}')" for t in SEARCH["all_of"]]
    parts.append("(" + " OR ".join(f"contains({hay}, '{t}')" for t in SEARCH["any_of"]) + ")")
    parts.append("NOT (" + " OR ".join(f"contains({hay}, '{t}')" for t in SEARCH["none_of"]) + ")")
    return " AND ".join(parts)


@query("search_posts", Q.with_(CANDS) + f"SELECT id, title FROM cands WHERE {_search_sql()}")
def q_search(spark, sf):
    return FL.search_items(B.conversation_candidates(spark, sf), **SEARCH).select("id", "title")


@query("search_posts_expression", Q.with_(CANDS) + """SELECT id, title FROM cands WHERE
  contains(lower(concat_ws(' ', title, selftext)), 'le') AND (contains(lower(concat_ws(' ', title, selftext)), 'eau la')
  OR contains(lower(concat_ws(' ', title, selftext)), 'ou')) AND NOT (contains(lower(concat_ws(' ', title, selftext)), 'xyz')
  OR contains(lower(concat_ws(' ', title, selftext)), 'vi'))""")
def q_search_expression(spark, sf):
    return FL.search_expression(B.conversation_candidates(spark, sf), '{LE} AND ("eau la" OR ou) NOT (xyz OR vi)').select(
        "id", "title")


@query("search_posts_by_postings", Q.with_(CANDS) + """SELECT id, title FROM cands WHERE
  (contains(lower(concat_ws(' ', title, selftext)), 'eau la') OR contains(lower(concat_ws(' ', title, selftext)), 'mente'))
  AND NOT contains(lower(concat_ws(' ', title, selftext)), 'vi')""")
def q_search_postings(spark, sf):
    """The same kind of search over stored texts and their trigrams."""
    index = TextIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/tables/postings-{uuid.uuid4().hex}")
    index.add(B.conversation_candidates(spark, sf))
    return index.search('("eau la" OR Mente) NOT vi').select("id", "title")


AS_OF = 902_000_000.0  # 1998-07-31, inside the order date range


@query("posts_by_community_and_time", Q.with_(Q.POSTS) + f"""
SELECT id, subreddit, created_utc FROM posts
WHERE subreddit IN ('1-URGENT', '2-HIGH') AND created_utc >= {int(AS_OF) - 31536000}.0 AND created_utc < {AS_OF - 86400}""")
def q_community_time(spark, sf):
    p = B.thread_posts(spark, sf)
    p = FL.community_filter(p, " 1-URGENT, 2-HIGH ,")
    p = FL.time_filter(p, "year", as_of=AS_OF, before=AS_OF - 86400)
    return p.select("id", "subreddit", "created_utc")


@query("work_queue_forced", Q.with_(Q.COMMENTS) +
       "SELECT id, status FROM comments WHERE status IN ('pending', 'processed')")
def q_work_queue(spark, sf):
    return FL.work_queue(B.thread_comments(spark, sf), force=True).select("id", "status")


@query("comment_quality_status", f"""
SELECT 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
       CASE WHEN {low_quality("CASE WHEN role = 'system' THEN 'AutoModerator' ELSE role END", 'text')}
            THEN 'skipped' ELSE 'pending' END AS status
FROM conversations WHERE turn > 0""")
def q_quality(spark, sf):
    c = B.conversation_comment_candidates(spark, sf)
    return c.select("id", IN.initial_status("author", "body").alias("status"))


@query("pending_queue", Q.with_(Q.COMMENTS) + "SELECT id, status FROM comments WHERE status = 'pending' "
       "ORDER BY id LIMIT 50")
def q_pending(spark, sf):
    return FL.pending_queue(B.thread_comments(spark, sf), 50).select("id", "status")


@query("annotation_inputs", Q.with_(Q.POSTS, Q.COMMENTS) + """
SELECT id AS item_id, 'post' AS item_type,
       'Title: ' || coalesce(title, 'None') || chr(10) || chr(10) || 'Body: ' || coalesce(selftext, 'None') AS text
FROM posts WHERE status = 'pending'
UNION ALL SELECT id, 'comment', coalesce(body, 'None') FROM comments WHERE status = 'pending'""")
def q_annotation_inputs(spark, sf):
    from themeflow.operators.annotate import annotation_inputs
    return annotation_inputs(B.thread_posts(spark, sf), B.thread_comments(spark, sf))


@query("retry_queue", """
SELECT 'e' || event_id::VARCHAR AS item_id, CASE event_type WHEN 'error' THEN '503 Service Unavailable'
       WHEN 'click' THEN 'Request Timeout' ELSE 'invalid JSON' END AS error, (user_id % 4)::INTEGER AS attempts
FROM events WHERE event_type IN ('error', 'click') AND user_id % 4 < 3""")
def q_retry(spark, sf):
    """Failed calls derived from events: errors and clicks carry transient
    messages, the rest a permanent one; attempts from the user id."""
    from themeflow.operators.annotate import retry_queue
    ev = B.table(spark, sf, "events")
    res = ev.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("item_id"),
                    F.when(F.col("event_type") == "error", "503 Service Unavailable")
                    .when(F.col("event_type") == "click", "Request Timeout")
                    .otherwise("invalid JSON").alias("error"),
                    (F.col("user_id") % 4).cast("int").alias("attempts"))
    return retry_queue(res)


# ------------------------------------------------------------ payload files
_CUT_LINE = '{"query_id":"r' + "' || conv_id || '" + '","source_priority":1,"page_no":1,"data":{"after":null,"children":[]}}'
_LINES_SQL = f"""lines AS (
  SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN substr(line, 1, 30) WHEN 1 THEN '[' || line || ']'
         WHEN 2 THEN replace(line, '"page_no":1', '"page_no":"first"') WHEN 3 THEN replace(line, '"query_id"', '"q"')
         WHEN 4 THEN '' ELSE line END AS record
  FROM (SELECT conv_id, '{_CUT_LINE}' AS line FROM conversations WHERE turn = 0))"""


@query("payload_quarantine", Q.with_(_LINES_SQL) + """
SELECT record, CASE conv_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object'
       WHEN 2 THEN 'field of a wrong type' ELSE 'no query_id' END AS reason
FROM lines WHERE conv_id % 6 < 4""")
def q_quarantine(spark, sf):
    """A payload line per conversation, five in six of them broken in some
    way, written as files; those that cannot be read whole, with the reason."""
    line = F.format_string(_CUT_LINE.replace("' || conv_id || '", "%s"), F.col("conv_id").cast("string"))
    kind = F.col("conv_id") % 6
    record = (F.when(kind == 0, F.substring(line, 1, 30)).when(kind == 1, F.concat(F.lit("["), line, F.lit("]")))
              .when(kind == 2, F.replace(line, F.lit('"page_no":1'), F.lit('"page_no":"first"')))
              .when(kind == 3, F.replace(line, F.lit('"query_id"'), F.lit('"q"')))
              .when(kind == 4, F.lit("")).otherwise(line))
    root = f"{checkpoint_dir(spark).rstrip('/')}/payloads/{uuid.uuid4().hex}"
    B.table(spark, sf, "conversations").filter("turn = 0").select(record.alias("value")).write.text(root)
    return PL.rejected_payloads(spark, "search", root).select("record", "reason")


@query("search_source_fallback", """
WITH pages AS (
  SELECT conv_id % 40 AS query_id, 1 + conv_id % 3 AS source_priority, conv_id // 120 AS page_no,
         CASE WHEN (conv_id % 40) % 3 >= 1 + conv_id % 3 AND conv_id // 120 = first_page THEN [] ELSE ids END AS ids
  FROM (SELECT conv_id, list(conv_id) OVER w AS ids, min(conv_id // 120) OVER (PARTITION BY conv_id % 40, conv_id % 3)
               AS first_page, row_number() OVER w AS nth
        FROM conversations WHERE turn = 0
        WINDOW w AS (PARTITION BY conv_id % 40, conv_id % 3, conv_id // 120)) WHERE nth = 1
), chosen AS (
  SELECT query_id, min(source_priority) AS source_priority
  FROM (SELECT query_id, source_priority, arg_min(len(ids), page_no) AS n FROM pages GROUP BY ALL) WHERE n > 0 GROUP BY ALL)
SELECT query_id::VARCHAR AS query_id, source_priority::INTEGER AS source_priority, 'c' || unnest(ids)::VARCHAR AS id
FROM pages JOIN chosen USING (query_id, source_priority)""")
def q_fallback(spark, sf):
    """Search pages of three sources; sources whose first page is empty are
    passed over."""
    conv = B.table(spark, sf, "conversations").filter("turn = 0").select(
        (F.col("conv_id") % 40).alias("q"), (1 + F.col("conv_id") % 3).alias("s"),
        F.floor(F.col("conv_id") / 120).alias("page_no"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"))
    first = conv.groupBy("q", "s").agg(F.min("page_no").alias("first"))
    post = F.struct(*[(F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in S.POST_FIELDS.fields])
    pages = conv.groupBy("q", "s", "page_no").agg(F.collect_list(post).alias("posts")).join(first, ["q", "s"])
    empty = (F.col("q") % 3 >= F.col("s")) & (F.col("page_no") == F.col("first"))
    pages = pages.select(F.col("q").cast("string").alias("query_id"), F.col("s").cast("int").alias("source_priority"),
                         F.col("page_no").cast("int").alias("page_no"),
                         F.when(empty, F.slice("posts", 1, 0)).otherwise(F.col("posts")).alias("posts"))
    return PL.post_candidates(PL.choose_search_source(pages)).select("query_id", "source_priority", "id")
