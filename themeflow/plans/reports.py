"""Registered theme reports and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators import stats as ST
from themeflow.operators import themes as TH
from themeflow.plans import sql as Q
from themeflow.plans.registry import query
from themeflow.sources import bindings as B


def _ann(spark, sf):
    return B.thread_annotations(spark, sf)


# ------------------------------------------------------------------ themes

_PARETO_SQL = Q.with_(Q.ANNOTATIONS, Q.THEME_ROWS, """g AS (
  SELECT consolidated_tag AS tag, count(*) AS items_in_theme,
         count(*) FILTER (WHERE item_type = 'post') AS post_items,
         count(*) FILTER (WHERE item_type = 'comment') AS comment_items
  FROM theme_rows GROUP BY consolidated_tag)""", """r AS (
  SELECT *, row_number() OVER (ORDER BY items_in_theme DESC, lower(tag), tag) AS rank,
         sum(items_in_theme) OVER () AS total_clustered_items FROM g)""") + f"""
SELECT rank::INTEGER AS rank, {Q.clean_text('tag', S.UNCLUSTERED)} AS theme, items_in_theme,
       items_in_theme / total_clustered_items * 100 AS share_percent,
       (sum(items_in_theme) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_items,
       sum(items_in_theme) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / total_clustered_items * 100
         AS cumulative_share_percent,
       post_items, comment_items, total_clustered_items::BIGINT AS total_clustered_items
FROM r WHERE {{where}}"""


@query("theme_pareto", _PARETO_SQL.replace("{where}", f"rank <= {S.DEFAULT_TOP_N}"))
def q_theme_pareto(spark, sf):
    """Flagship: Pareto table of the top 20 themes."""
    return TH.pareto(_ann(spark, sf), top_n=S.DEFAULT_TOP_N)


@query("theme_pareto_all", _PARETO_SQL.replace("{where}", "true"))
def q_theme_pareto_all(spark, sf):
    """Pareto table of all themes (distributed running sum)."""
    return TH.pareto(_ann(spark, sf), top_n=0)


@query("theme_dominance_summary", Q.with_(Q.ANNOTATIONS, Q.THEME_ROWS, f"""t AS (
  SELECT {Q.clean_text('consolidated_tag', S.UNCLUSTERED)} AS tag,
         {Q.clean_text('cluster_explanation')} AS expl FROM theme_rows)""", """c AS (
  SELECT tag, count(*) AS n FROM t GROUP BY tag)""", """e AS (
  SELECT tag, expl, count(*) AS m FROM t WHERE expl <> '' GROUP BY tag, expl)""", """mode AS (
  SELECT tag, arg_min(expl, (-m, expl)) AS expl FROM e GROUP BY tag)""") + """
SELECT c.tag AS consolidated_tag,
       round_even(c.n / sum(c.n) OVER () * 100, 1)::DOUBLE AS cluster_dominance_percent,
       coalesce(mode.expl, '') AS consolidated_tag_explanation, c.n AS items_in_theme
FROM c LEFT JOIN mode ON c.tag = mode.tag""")
def q_theme_dominance_summary(spark, sf):
    return TH.dominance_summary(_ann(spark, sf))


@query("theme_counts", Q.with_(Q.ANNOTATIONS, Q.CHART_ROWS) +
       "SELECT theme, count(*) AS count FROM chart_rows GROUP BY theme")
def q_theme_counts(spark, sf):
    return TH.theme_counts(_ann(spark, sf))


@query("theme_dominance_chart", Q.with_(Q.ANNOTATIONS, Q.CHART_ROWS, """c AS (
  SELECT theme, count(*) AS count FROM chart_rows GROUP BY theme)""", """r AS (
  SELECT *, row_number() OVER (ORDER BY count DESC, lower(theme), theme) AS rank,
         sum(count) OVER () AS total FROM c)""") + f"""
SELECT rank::INTEGER AS rank, theme, count, count / total * 100 AS percent,
       sum(count) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / total * 100 AS cumulative_percent
FROM r WHERE rank <= {S.DEFAULT_TOP_N}""")
def q_theme_dominance_chart(spark, sf):
    return TH.dominance_chart(_ann(spark, sf), top_n=S.DEFAULT_TOP_N)


_BUCKETS_SQL = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in S.SENTIMENT_BUCKETS) + ") AS b(sentiment)"


@query("sentiment_by_theme", Q.with_(Q.ANNOTATIONS, Q.CHART_ROWS, f"""cells AS (
  SELECT theme, {Q.bucket('sentiment')} AS sentiment, count(*) AS count FROM chart_rows GROUP BY ALL)""", f"""top AS (
  SELECT theme, sum(count) AS theme_items FROM cells GROUP BY theme
  ORDER BY theme_items DESC, lower(theme), theme LIMIT {S.DEFAULT_TOP_N})""") + f"""
SELECT top.theme, top.theme_items::BIGINT AS theme_items, b.sentiment, {Q.bucket_label('b.sentiment')} AS sentiment_label,
       coalesce(cells.count, 0) AS count, coalesce(cells.count, 0) / top.theme_items * 100 AS percent
FROM top CROSS JOIN {_BUCKETS_SQL}
LEFT JOIN cells ON cells.theme = top.theme AND cells.sentiment = b.sentiment""")
def q_sentiment_by_theme(spark, sf):
    return TH.sentiment_by_theme(_ann(spark, sf))


# ------------------------------------------------------------------- stats

@query("status_counts", Q.with_(Q.POSTS, Q.COMMENTS) + """
SELECT 'post' AS item_type, status, count(*) AS n FROM posts GROUP BY status
UNION ALL SELECT 'comment', status, count(*) FROM comments GROUP BY status""")
def q_status_counts(spark, sf):
    return ST.status_counts(B.thread_posts(spark, sf), B.thread_comments(spark, sf))


@query("mean_sentiment", Q.with_(Q.ANNOTATIONS) + """
SELECT t.item_type, round(avg(a.sentiment), 9) AS average_sentiment, count(a.item_id) AS n
FROM (VALUES ('post'), ('comment')) AS t(item_type) LEFT JOIN annotations a ON a.item_type = t.item_type
GROUP BY t.item_type""")
def q_mean_sentiment(spark, sf):
    out = ST.mean_sentiment(_ann(spark, sf))
    return out.withColumn("average_sentiment", F.round("average_sentiment", 9))


@query("substance_distribution", Q.with_(Q.ANNOTATIONS) + """
SELECT count(*) FILTER (WHERE coalesce(is_substantive, false)) AS substantive,
       count(*) FILTER (WHERE NOT coalesce(is_substantive, false)) AS reaction_only,
       count(*) AS total,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE coalesce(is_substantive, false)) / count(*) * 100 ELSE 0.0 END
         AS substantive_percent,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE NOT coalesce(is_substantive, false)) / count(*) * 100 ELSE 0.0 END
         AS reaction_only_percent
FROM annotations""")
def q_substance_distribution(spark, sf):
    return ST.substance_distribution(_ann(spark, sf))


@query("sentiment_distribution", Q.with_(Q.ANNOTATIONS, f"""cells AS (
  SELECT item_type, {Q.bucket('sentiment')} AS sentiment, count(*) AS n FROM annotations GROUP BY ALL)""", """counts AS (
  SELECT item_type AS scope, sentiment, n FROM cells WHERE item_type IN ('post', 'comment')
  UNION ALL SELECT 'all', sentiment, sum(n) FROM cells GROUP BY sentiment)""", f"""grid AS (
  SELECT s.scope, b.sentiment, coalesce(c.n, 0) AS n
  FROM (VALUES ('all'), ('post'), ('comment')) AS s(scope) CROSS JOIN {_BUCKETS_SQL}
  LEFT JOIN counts c ON c.scope = s.scope AND c.sentiment = b.sentiment)""") + f"""
SELECT scope, sentiment, {Q.bucket_label('sentiment')} AS sentiment_label, n::BIGINT AS count,
       CASE WHEN sum(n) OVER (PARTITION BY scope) > 0 THEN n / sum(n) OVER (PARTITION BY scope) * 100 ELSE 0.0 END
         AS percent
FROM grid""")
def q_sentiment_distribution(spark, sf):
    return ST.sentiment_distribution(_ann(spark, sf))


@query("unmapped_raw_tags", Q.with_(Q.ANNOTATIONS) +
       "SELECT DISTINCT raw_tag FROM annotations WHERE consolidated_tag IS NULL")
def q_unmapped_raw_tags(spark, sf):
    return ST.unmapped_raw_tags(_ann(spark, sf))


@query("consolidated_tags_of_comments", Q.with_(Q.ANNOTATIONS) +
       "SELECT DISTINCT consolidated_tag FROM annotations WHERE item_type = 'comment' "
       "AND consolidated_tag IS NOT NULL AND consolidated_tag <> ''")
def q_consolidated_tags(spark, sf):
    return ST.consolidated_tags(_ann(spark, sf), "comment")


@query("dominance_summary_markdown", Q.with_(Q.ANNOTATIONS, Q.THEME_ROWS, f"""t AS (
  SELECT {Q.clean_text('consolidated_tag', S.UNCLUSTERED)} AS tag,
         {Q.clean_text('cluster_explanation')} AS expl FROM theme_rows)""", """c AS (
  SELECT tag, count(*) AS n FROM t GROUP BY tag)""", """e AS (
  SELECT tag, expl, count(*) AS m FROM t WHERE expl <> '' GROUP BY tag, expl)""", """mode AS (
  SELECT tag, arg_min(expl, (-m, expl)) AS expl FROM e GROUP BY tag)""", """s AS (
  SELECT c.tag, c.n, round_even(c.n / sum(c.n) OVER () * 100, 1)::DOUBLE AS pct, coalesce(mode.expl, '') AS expl
  FROM c LEFT JOIN mode ON c.tag = mode.tag)""") + """
SELECT 1::BIGINT AS line_no, '| Consolidated tag | Cluster dominance percentage | Consolidated tag explanation |' AS value
UNION ALL SELECT 2, '|---|---:|---|'
UNION ALL
SELECT (row_number() OVER (ORDER BY n DESC, lower(tag), tag) + 2)::BIGINT,
       '| ' || replace(tag, '|', '\\|') || ' | ' || format('{:.1f}', pct) || '% | ' || replace(expl, '|', '\\|') || ' |'
FROM s""")
def q_markdown(spark, sf):
    from themeflow.sources.sinks import summary_markdown_lines
    return summary_markdown_lines(TH.dominance_summary(_ann(spark, sf)))


@query("analysis_frame", Q.with_(Q.ANNOTATIONS) + f"""
SELECT item_id, item_type, sentiment, {Q.clean_text('consolidated_tag', S.UNCLUSTERED)} AS consolidated_tag,
       coalesce(cluster_id, -1) AS cluster_id, is_substantive FROM annotations""")
def q_analysis_frame(spark, sf):
    return TH.analysis_frame(_ann(spark, sf)).select("item_id", "item_type", "sentiment", "consolidated_tag",
                                                     "cluster_id", "is_substantive")


@query("compact_themes", Q.with_(Q.ANNOTATIONS, f"""c AS (
  SELECT consolidated_tag, count(*) AS n FROM annotations WHERE consolidated_tag IS NOT NULL
  GROUP BY consolidated_tag)""", f"""top AS (
  SELECT consolidated_tag FROM c ORDER BY n DESC, lower(consolidated_tag), consolidated_tag LIMIT {S.COMPACT_TOP_N})""") + f"""
SELECT a.item_id, CASE WHEN t.consolidated_tag IS NOT NULL THEN a.consolidated_tag ELSE '{S.OTHER_THEMES}' END
         AS theme_display
FROM annotations a LEFT JOIN top t ON a.consolidated_tag = t.consolidated_tag""")
def q_compact(spark, sf):
    return TH.compact_themes(_ann(spark, sf)).select("item_id", "theme_display")


@query("chart_sentiment_distribution", Q.with_(Q.ANNOTATIONS, f"""cells AS (
  SELECT item_type, {Q.bucket('sentiment')} AS sentiment, count(*) AS n FROM annotations GROUP BY ALL)""", """counts AS (
  SELECT item_type AS scope, sentiment, n FROM cells WHERE item_type IN ('post', 'comment')
  UNION ALL SELECT 'all', sentiment, sum(n) FROM cells GROUP BY sentiment)""", f"""grid AS (
  SELECT s.scope, b.sentiment, coalesce(c.n, 0) AS n
  FROM (VALUES ('all'), ('post'), ('comment')) AS s(scope) CROSS JOIN {_BUCKETS_SQL}
  LEFT JOIN counts c ON c.scope = s.scope AND c.sentiment = b.sentiment)""") + f"""
SELECT CASE scope WHEN 'all' THEN 'All' WHEN 'post' THEN 'Posts' ELSE 'Comments' END AS scope, sentiment,
       {Q.bucket_label('sentiment')} AS sentiment_label, n::BIGINT AS count,
       CASE WHEN sum(n) OVER (PARTITION BY scope) > 0 THEN n / sum(n) OVER (PARTITION BY scope) * 100 ELSE 0.0 END
         AS percent
FROM grid""")
def q_chart_sentiment(spark, sf):
    return ST.sentiment_distribution(_ann(spark, sf), {"all": "All", "post": "Posts", "comment": "Comments"})


# ------------------------------------------------------------- documents
DOCS = """annotations AS (
  SELECT 'd' || d.doc_id::VARCHAR AS item_id, d.lang AS item_type, d.text AS summary, d.source AS raw_tag,
         l.quality = 1 AS is_substantive, d.source AS consolidated_tag, d.text AS cluster_explanation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("document_substance", Q.with_(DOCS) + """
SELECT count(*) FILTER (WHERE coalesce(is_substantive, false)) AS substantive,
       count(*) FILTER (WHERE NOT coalesce(is_substantive, false)) AS reaction_only,
       count(*) AS total,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE coalesce(is_substantive, false)) / count(*) * 100 ELSE 0.0 END
         AS substantive_percent,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE NOT coalesce(is_substantive, false)) / count(*) * 100 ELSE 0.0 END
         AS reaction_only_percent
FROM annotations""")
def q_doc_substance(spark, sf):
    return ST.substance_distribution(B.document_annotations(spark, sf))


@query("document_theme_summary", Q.with_(DOCS, Q.THEME_ROWS, f"""t AS (
  SELECT {Q.clean_text('consolidated_tag', S.UNCLUSTERED)} AS tag,
         {Q.clean_text('cluster_explanation')} AS expl FROM theme_rows)""", """c AS (
  SELECT tag, count(*) AS n FROM t GROUP BY tag)""", """e AS (
  SELECT tag, expl, count(*) AS m FROM t WHERE expl <> '' GROUP BY tag, expl)""", """mode AS (
  SELECT tag, arg_min(expl, (-m, expl)) AS expl FROM e GROUP BY tag)""") + """
SELECT c.tag AS consolidated_tag,
       round_even(c.n / sum(c.n) OVER () * 100, 1)::DOUBLE AS cluster_dominance_percent,
       coalesce(mode.expl, '') AS consolidated_tag_explanation, c.n AS items_in_theme
FROM c LEFT JOIN mode ON c.tag = mode.tag""")
def q_doc_summary(spark, sf):
    """Dominance summary over documents: whole texts are cleaned as
    explanations; unlabelled documents (null flag) do not count."""
    return TH.dominance_summary(B.document_annotations(spark, sf))


@query("document_pareto_with_reactions", Q.with_(DOCS, """theme_rows AS (
  SELECT * FROM annotations WHERE consolidated_tag IS NOT NULL AND trim(consolidated_tag, ' ') <> ''
    AND lower(trim(consolidated_tag, ' ')) <> 'unclustered')""", """g AS (
  SELECT consolidated_tag AS tag, count(*) AS items_in_theme,
         count(*) FILTER (WHERE item_type = 'post') AS post_items,
         count(*) FILTER (WHERE item_type = 'comment') AS comment_items
  FROM theme_rows GROUP BY consolidated_tag)""", """r AS (
  SELECT *, row_number() OVER (ORDER BY items_in_theme DESC, lower(tag), tag) AS rank,
         sum(items_in_theme) OVER () AS total_clustered_items FROM g)""") + f"""
SELECT rank::INTEGER AS rank, {Q.clean_text('tag', S.UNCLUSTERED)} AS theme, items_in_theme,
       items_in_theme / total_clustered_items * 100 AS share_percent,
       (sum(items_in_theme) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_items,
       sum(items_in_theme) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / total_clustered_items * 100
         AS cumulative_share_percent,
       post_items, comment_items, total_clustered_items::BIGINT AS total_clustered_items
FROM r WHERE rank <= 10""")
def q_doc_pareto(spark, sf):
    """Pareto of document sources with reaction-only rows included: twenty
    sources of equal size, so every rank is decided by the name order."""
    return TH.pareto(B.document_annotations(spark, sf), top_n=10, include_reaction_only=True)


EVENTS = """annotations AS (
  SELECT 'e' || event_id::VARCHAR AS item_id,
         CASE WHEN event_type = 'click' THEN 'post' WHEN event_type = 'view' THEN 'comment' ELSE event_type END
           AS item_type,
         value / 50 - 1 AS sentiment FROM events)"""


@query("event_sentiment_distribution", Q.with_(EVENTS, f"""cells AS (
  SELECT item_type, {Q.bucket('sentiment')} AS sentiment, count(*) AS n FROM annotations GROUP BY ALL)""", """counts AS (
  SELECT item_type AS scope, sentiment, n FROM cells WHERE item_type IN ('post', 'comment')
  UNION ALL SELECT 'all', sentiment, sum(n) FROM cells GROUP BY sentiment)""", f"""grid AS (
  SELECT s.scope, b.sentiment, coalesce(c.n, 0) AS n
  FROM (VALUES ('all'), ('post'), ('comment')) AS s(scope) CROSS JOIN {_BUCKETS_SQL}
  LEFT JOIN counts c ON c.scope = s.scope AND c.sentiment = b.sentiment)""") + f"""
SELECT scope, sentiment, {Q.bucket_label('sentiment')} AS sentiment_label, n::BIGINT AS count,
       CASE WHEN sum(n) OVER (PARTITION BY scope) > 0 THEN n / sum(n) OVER (PARTITION BY scope) * 100 ELSE 0.0 END
         AS percent
FROM grid""")
def q_event_sentiment(spark, sf):
    """Continuous raw sentiments (value / 50 - 1); other event types count in
    the ``all`` scope only."""
    return ST.sentiment_distribution(B.event_annotations(spark, sf))


DOC_SEARCH = dict(all_of=["la"], any_of=["eau", "mente"], none_of=["zzz"])


@query("document_search", """
SELECT 'd' || doc_id::VARCHAR AS item_id, source FROM documents
WHERE contains(lower(coalesce(text, '')), 'la') AND (contains(lower(coalesce(text, '')), 'eau')
      OR contains(lower(coalesce(text, '')), 'mente')) AND NOT contains(lower(coalesce(text, '')), 'zzz')""")
def q_doc_search(spark, sf):
    """Boolean search over whole document texts."""
    from themeflow.operators.filters import search_items
    d = B.document_annotations(spark, sf)
    return search_items(d, fields=("summary",), **DOC_SEARCH).select("item_id", F.col("raw_tag").alias("source"))
