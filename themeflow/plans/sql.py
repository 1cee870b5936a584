"""DuckDB SQL used as an independent oracle for the registered queries.

Written by hand against the same parquet views; shares no code with the Spark
side apart from the fixed values in ``themeflow.schemas``."""

from __future__ import annotations

from themeflow import schemas as S

# RE2's \s is ASCII only; list the Unicode white space Python's str.split uses.
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CTRL = r"[\x00-\x1f\x7f-\x9f]"


def fold(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_CTRL}', ' ', 'g'), '{_WS}', ' ', 'g')"


def clean_text(x: str, default: str = "") -> str:
    return f"coalesce(nullif(trim({fold(x)}, ' '), ''), '{default}')"


def clean_label_text(x: str) -> str:
    chars = S.LABEL_STRIP_CHARS.replace("'", "''")
    return f"coalesce(trim({fold(x)}, '{chars}'), '')"


def bucket(x: str) -> str:
    b = S.SENTIMENT_BUCKETS
    d = [f"abs(({v}) - ({x}))" for v in b]
    whens = []
    for i in range(len(b) - 1):
        cond = " AND ".join(f"{d[i]} <= {d[j]}" for j in range(i + 1, len(b)))
        whens.append(f"WHEN {cond} THEN {b[i]}")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL {' '.join(whens)} ELSE {b[-1]} END)::DOUBLE"


def bucket_label(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {k} THEN '{v}'" for k, v in S.SENTIMENT_LABELS.items())
    return f"(CASE {whens} END)"


def comment_id() -> str:
    return ("'l' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR"
            " || '-' || l_suppkey::VARCHAR || '-' || strftime(l_shipdate, '%Y%m%d')")


POSTS = """posts AS (
  SELECT 'o' || o_orderkey::VARCHAR AS id, o_orderpriority AS subreddit,
         'order ' || o_orderkey::VARCHAR AS title, 'customer ' || o_custkey::VARCHAR AS selftext,
         o_custkey::BIGINT AS score, epoch(o_orderdate)::DOUBLE AS created_utc,
         CASE WHEN o_orderstatus = 'F' THEN 'processed'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'skipped'
              WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status
  FROM orders)"""

COMMENTS = f"""comments AS (
  SELECT {comment_id()} AS id, 'o' || l_orderkey::VARCHAR AS post_id,
         'line ' || l_linenumber::VARCHAR || ' of order ' || l_orderkey::VARCHAR AS body,
         l_quantity::BIGINT AS score, epoch(l_shipdate)::DOUBLE AS created_utc,
         CASE WHEN l_linestatus = 'F' THEN 'processed'
              WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'skipped' ELSE 'pending' END AS status
  FROM lineitem)"""

ANNOTATIONS = f"""annotations AS (
  SELECT 'o' || o_orderkey::VARCHAR AS item_id, 'post' AS item_type,
         (o_custkey % 9 - 4) / 4.0 AS sentiment, concat_ws(' ', p_brand, p_type) AS summary,
         CASE WHEN o_orderstatus <> 'P' THEN p_type ELSE 'Reaction Only' END AS raw_tag,
         o_orderstatus <> 'P' AS is_substantive,
         CASE WHEN o_orderstatus <> 'P' THEN p_type END AS reception_reason,
         p_name AS consolidated_tag, 'because ' || p_brand AS cluster_explanation,
         p_size::INTEGER AS cluster_id, NULL::FLOAT[] AS embedding
  FROM orders LEFT JOIN part ON o_custkey = p_partkey
  UNION ALL
  SELECT {comment_id()} AS item_id, 'comment' AS item_type,
         l_discount * 20 - 1 AS sentiment, concat_ws(' ', p_brand, p_type) AS summary,
         p_type AS raw_tag, l_returnflag <> 'R' AS is_substantive,
         CASE WHEN l_returnflag <> 'R' THEN p_type END AS reception_reason,
         CASE WHEN l_tax = 0.0 THEN NULL WHEN l_linenumber = 7 THEN p_name || chr(9) ELSE p_name END
           AS consolidated_tag,
         CASE WHEN l_tax <> 0.01 THEN 'because ' || p_brand END AS cluster_explanation,
         CASE WHEN l_tax = 0.0 THEN NULL ELSE p_size END::INTEGER AS cluster_id, NULL::FLOAT[] AS embedding
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

THEME_ROWS = """theme_rows AS (
  SELECT * FROM annotations
  WHERE consolidated_tag IS NOT NULL AND trim(consolidated_tag, ' ') <> ''
    AND lower(trim(consolidated_tag, ' ')) <> 'unclustered' AND is_substantive)"""

CHART_ROWS = f"""chart_rows AS (
  SELECT *, {clean_text('consolidated_tag', S.UNCLUSTERED)} AS theme FROM annotations
  WHERE coalesce(is_substantive, false)
    AND {clean_text('consolidated_tag', S.UNCLUSTERED)} <> '{S.UNCLUSTERED}')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ANN_COLS = ("item_id, item_type, sentiment, summary, raw_tag, is_substantive, reception_reason, "
            "consolidated_tag, cluster_explanation, cluster_id, embedding")
POST_COLS = "id, subreddit, title, selftext, score, created_utc, status"
COMMENT_COLS = "id, post_id, body, score, created_utc, status"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def snippet(x: str) -> str:
    return (f"CASE WHEN length({x}) > 45 THEN substr(replace({x}, chr(10), ' '), 1, 45) || '...' "
            f"ELSE replace({x}, chr(10), ' ') END")


def tag_display(a: str = "a") -> str:
    q = "''''"
    return (f"CASE WHEN coalesce({a}.consolidated_tag, '') <> '' THEN {q} || {a}.consolidated_tag || {q} "
            f"WHEN {a}.item_id IS NOT NULL THEN 'raw: ' || {q} || coalesce({a}.raw_tag, 'None') || {q} "
            f"ELSE 'None' END")
