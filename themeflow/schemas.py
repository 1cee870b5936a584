"""Table schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the original tool's for equal results.
# ---------------------------------------------------------------------------
SENTIMENT_BUCKETS = [-1.0, -0.5, 0.0, 0.5, 1.0]
SENTIMENT_LABELS = {
    -1.0: "Strongly Negative",
    -0.5: "Mildly Negative",
    0.0: "Neutral/Mixed",
    0.5: "Mildly Positive",
    1.0: "Strongly Positive",
}
ITEM_STATUSES = ["pending", "processed", "failed", "skipped"]
ITEM_TYPES = ["post", "comment"]
LOW_QUALITY_AUTHOR = "automoderator"
LOW_QUALITY_AUTHOR_PART = "bot"
LOW_QUALITY_BODIES = ["[deleted]", "[removed]", ""]
LABEL_STRIP_CHARS = " \"'`.,;:-"
EXPLANATION_STRIP_CHARS = " \"'`"
UNCLUSTERED = "Unclustered"
REACTION_ONLY = "Reaction Only"
OFF_TOPIC = "Off Topic"
OTHER_THEMES = "Other themes"
GENERIC_LABEL_PATTERN = r"cluster\s*[a-z0-9_-]*"
RETRY_MARKERS = [
    "429", "rate limit", "rate_limit", "too many requests", "timeout", "temporarily",
    "connection", "server error", "502", "503", "504",
]
RETRY_ATTEMPTS = 3
TIME_FILTER_SECONDS = {"day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
EXPLANATION_WITH_SUMMARY = "This cluster is labeled '{label}' because representative items share this pattern: {summary}"
EXPLANATION_WITHOUT_SUMMARY = "This cluster is labeled '{label}' based on the representative raw tags in the cluster."
EXPLANATION_NO_CLUSTERS = ("HDBSCAN found no stable clusters, so this item keeps its strongest available "
                           "reception reason: {label}.")
BULK_NEW_SUMMARY = "Bulk manually annotated"
BULK_EDIT_SUMMARY = "Bulk manually edited"
SINGLE_NEW_SUMMARY = "Manually annotated"
SINGLE_EDIT_SUMMARY = "Manually edited"
EMBEDDING_TEXT = "Reception Reason: {reason} | Raw Tag: {tag} | Summary: {summary}"
LABEL_LINE = "- Reception Reason: '{reason}' | Raw Tag: '{tag}' | Summary: '{summary}'"
DEFAULT_POST_LIMIT = 50
DEFAULT_COMMENT_LIMIT = 25
DEFAULT_MIN_CLUSTER_SIZE = 5
DEFAULT_LABEL_SAMPLE_SIZE = 15
PAGE_SIZE = 10
SNIPPET_WIDTH = 45
DEFAULT_TOP_N = 20
COMPACT_TOP_N = 10
# ---------------------------------------------------------------------------

POSTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

COMMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("post_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

ANNOTATIONS = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("item_type", T.StringType()),
    T.StructField("sentiment", T.DoubleType()),
    T.StructField("summary", T.StringType()),
    T.StructField("raw_tag", T.StringType()),
    T.StructField("is_substantive", T.BooleanType()),
    T.StructField("reception_reason", T.StringType()),
    T.StructField("consolidated_tag", T.StringType()),
    T.StructField("cluster_explanation", T.StringType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# Columns added after the first layout (schema evolution, see state.evolve_annotations).
LATE_ANNOTATION_COLUMNS = ["cluster_explanation", "is_substantive", "reception_reason"]

POST_FIELDS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
])

COMMENT_FIELDS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
])

# Raw payload layouts (JSON files).
SEARCH_PAGE = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("after", T.StringType()),
        T.StructField("children", T.ArrayType(T.StructType([
            T.StructField("kind", T.StringType()),
            T.StructField("data", POST_FIELDS),
        ]))),
    ])),
])

COMMENT_LISTING = T.ArrayType(T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("children", T.ArrayType(T.StructType([
            T.StructField("kind", T.StringType()),
            T.StructField("data", COMMENT_FIELDS),
        ]))),
    ])),
]))

ARCHIVE_POSTS = T.StructType([T.StructField("data", T.ArrayType(POST_FIELDS))])
ARCHIVE_COMMENTS = T.StructType([T.StructField("data", T.ArrayType(COMMENT_FIELDS))])
