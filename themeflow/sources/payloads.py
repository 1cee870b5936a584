"""Readers for raw discussion payload files (JSON lines).

Every line is one fetched payload plus its context:

* search page   ``{"query_id", "source_priority", "page_no", "data": {"after", "children": [{"kind", "data": POST}]}}``
* archive page  ``{"query_id", "source_priority", "page_no", "data": [POST, ...]}``
* comment page  ``{"post_id", "source_priority", "payload": [{...}, {"data": {"children": [{"kind", "data": COMMENT}]}}]}``
* archive comments ``{"post_id", "source_priority", "data": [COMMENT, ...]}``

``source_priority`` orders the sources of one search or post (1 = tried
first). Reading is one scan over all files; choosing the source is a
page-level aggregate, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow import schemas as S

# rank = page_no * offset + position in the page; positions are below 2**31,
# so ranks of pages never overlap
PAGE_ROW_OFFSET = 1 << 31

_SEARCH_FILE = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
    T.StructField("page_no", T.IntegerType()),
    *S.SEARCH_PAGE.fields,
])
_ARCHIVE_FILE = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
    T.StructField("page_no", T.IntegerType()),
    *S.ARCHIVE_POSTS.fields,
])
_COMMENT_FILE = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
    T.StructField("payload", T.StringType()),  # raw JSON text, validated below
])
_ARCHIVE_COMMENT_FILE = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
    *S.ARCHIVE_COMMENTS.fields,
])

_POST_COLS = [f.name for f in S.POST_FIELDS.fields]
_COMMENT_COLS = [f.name for f in S.COMMENT_FIELDS.fields]


def json_lines(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The usual reader of payload files. The page functions take another one
    with these arguments, for payloads kept elsewhere."""
    return spark.read.schema(schema).json(path)


#: Reader kinds: the schema of a line and the field that says whose payload it is.
PAYLOAD_KINDS = {"search": (_SEARCH_FILE, "query_id"), "archive": (_ARCHIVE_FILE, "query_id"),
                 "comments": (_COMMENT_FILE, "post_id"), "archive_comments": (_ARCHIVE_COMMENT_FILE, "post_id")}
_RECORD = "_corrupt_record"


def _rejects(lines: DataFrame, kind: str) -> DataFrame:
    """(file, record, reason) of the lines of ``value`` that are no whole
    payload. Lines with fields of a wrong type are read as far as they go and
    listed as well; empty lines are none."""
    schema, owner = PAYLOAD_KINDS[kind]
    full = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])
    parsed = lines.select("file", F.col("value").alias("record"), F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD}).alias("p"),
        F.try_parse_json("value").alias("json"))
    reason = (F.when(F.col("json").isNull(), F.lit("not JSON"))
              .when(~F.schema_of_variant("json").startswith("OBJECT"), F.lit("not an object"))
              .when(F.col(f"p.{_RECORD}").isNotNull(), F.lit("field of a wrong type"))
              .when(F.coalesce(F.col(f"p.{owner}"), F.lit("")) == "", F.lit(f"no {owner}")))
    return parsed.select("file", "record", reason.alias("reason")).filter(
        F.col("reason").isNotNull() & (F.trim("record") != ""))


def rejected_payloads(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Payload lines under ``path`` that cannot be read as a ``kind`` of
    ``PAYLOAD_KINDS``, one row per line with its file and the reason."""
    return _rejects(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), kind)


def rejected_stream(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The same of payload files that arrive in a folder."""
    return _rejects(spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("file")), kind)


def search_pages(spark: SparkSession, path: str, reader=json_lines) -> DataFrame:
    """Direct/browser search pages -> one row per page with its posts array."""
    return search_page_rows(reader(spark, _SEARCH_FILE, path))


def search_page_rows(raw: DataFrame, *more: str) -> DataFrame:
    """Parsed search payloads (of a table or a stream) -> page rows, with
    ``more`` columns as they are."""
    return raw.select("query_id", "source_priority", "page_no",
                      F.transform(F.coalesce(F.col("data.children"), F.array()), lambda c: c["data"]).alias("posts"),
                      F.col("data.after").alias("after"), *more)


def archive_pages(spark: SparkSession, path: str, reader=json_lines) -> DataFrame:
    """Flat archive pages -> one row per page with its posts array."""
    df = reader(spark, _ARCHIVE_FILE, path)
    return df.select("query_id", "source_priority", "page_no",
                     F.coalesce(F.col("data"), F.array()).alias("posts"), F.lit(None).cast("string").alias("after"))


def choose_search_source(pages: DataFrame) -> DataFrame:
    """Per query keep the pages of the first source whose first page is
    non-empty. Works on page rows (one per fetched page)."""
    first = (pages.groupBy("query_id", "source_priority")
             .agg(F.min_by(F.size("posts"), F.col("page_no")).alias("__first_n")))
    chosen = (first.filter(F.col("__first_n") > 0).groupBy("query_id")
              .agg(F.min("source_priority").alias("source_priority")))
    return pages.join(chosen, ["query_id", "source_priority"], "left_semi")


def post_candidates(pages: DataFrame, *more: str) -> DataFrame:
    """Explode chosen pages into post candidates with a search rank (a page
    without a number is the first). ``more`` columns are kept."""
    ex = pages.select("query_id", "source_priority", "page_no", *more, F.posexplode("posts").alias("pos", "p"))
    return ex.select(
        "query_id", "source_priority", *more,
        (F.coalesce("page_no", F.lit(1)).cast("long") * PAGE_ROW_OFFSET + F.col("pos")).alias("rank"),
        *[F.col(f"p.{c}").alias(c) for c in _POST_COLS])


def read_post_candidates(spark: SparkSession, search_path: str | None = None,
                         archive_path: str | None = None, reader=json_lines) -> DataFrame:
    """All search sources of a run, fallback applied, as post candidates."""
    parts = []
    if search_path:
        parts.append(search_pages(spark, search_path, reader))
    if archive_path:
        parts.append(archive_pages(spark, archive_path, reader))
    if not parts:
        raise ValueError("no payload path given")
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionByName(p)
    return post_candidates(choose_search_source(pages))


def comment_pages(spark: SparkSession, path: str, comment_limit: int = S.DEFAULT_COMMENT_LIMIT,
                  reader=json_lines) -> DataFrame:
    """Direct comment listings -> (post_id, source, valid, comments).

    Valid = a JSON list of at least two elements; comments come from element
    two, ``kind = 't1'`` only, first ``comment_limit`` of them. The cap is an
    array slice inside the row: no shuffle and no per-post window."""
    df = reader(spark, _COMMENT_FILE, path)
    parsed = F.from_json(F.col("payload"), S.COMMENT_LISTING)
    valid = parsed.isNotNull() & (F.size(parsed) >= 2)
    kids = F.coalesce(F.element_at(parsed, 2)["data"]["children"], F.array())
    t1 = F.filter(kids, lambda c: c["kind"] == "t1")
    return df.select("post_id", "source_priority", F.coalesce(valid, F.lit(False)).alias("valid"),
                     F.when(valid, F.slice(F.transform(t1, lambda c: c["data"]), 1, comment_limit))
                     .alias("comments"))


def archive_comment_pages(spark: SparkSession, path: str, reader=json_lines) -> DataFrame:
    """Archive comments -> same layout; no kind test, no client-side cap."""
    df = reader(spark, _ARCHIVE_COMMENT_FILE, path)
    return df.select("post_id", "source_priority", F.col("data").isNotNull().alias("valid"),
                     F.col("data").alias("comments"))


def choose_comment_source(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per post keep the first source with a valid payload (valid but empty
    wins). Returns (chosen pages, invalid payload rows)."""
    chosen = (pages.filter("valid").groupBy("post_id").agg(F.min("source_priority").alias("source_priority")))
    return (pages.join(chosen, ["post_id", "source_priority"], "left_semi"),
            pages.filter(~F.col("valid")).select("post_id", "source_priority"))


def comment_candidates(pages: DataFrame) -> DataFrame:
    ex = pages.select("post_id", F.posexplode("comments").alias("pos", "c"))
    return ex.select("post_id", "pos", *[F.col(f"c.{c}").alias(c) for c in _COMMENT_COLS])


def read_comment_candidates(spark: SparkSession, comment_path: str | None = None,
                            archive_path: str | None = None,
                            comment_limit: int = S.DEFAULT_COMMENT_LIMIT,
                            reader=json_lines) -> tuple[DataFrame, DataFrame]:
    parts = []
    if comment_path:
        parts.append(comment_pages(spark, comment_path, comment_limit, reader))
    if archive_path:
        parts.append(archive_comment_pages(spark, archive_path, reader))
    if not parts:
        raise ValueError("no payload path given")
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionByName(p)
    chosen, invalid = choose_comment_source(pages)
    return comment_candidates(chosen), invalid
