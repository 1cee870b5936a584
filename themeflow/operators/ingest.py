"""Ingest of discussion threads: quality status, de-duplication, quotas.

Input frames are *candidates*: one row per post found by a search, with a
``query_id`` and search-order keys, and comment candidates with ``post_id``
and their position in the thread. Readers for raw payload files live in
``themeflow.sources.payloads``.

Per-group "first k" rules go in two steps for large k: the first k of each of
``SALTS`` parts of a group, then of the group, so a query or post that holds a
third of all rows is never one task. Up to ``PARTIAL_K`` Spark itself limits
groups before the shuffle (WindowGroupLimit), and one step is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators.skew import SALTS, salted_join

PARTIAL_K = 1000    # spark.sql.optimizer.windowGroupLimitThreshold


def is_low_quality(author, body) -> Column:
    """Moderator bot, any author containing ``bot``, or a deleted/removed/
    empty body. Case-insensitive; nulls count as empty; no trimming."""
    a = F.lower(F.coalesce(F.col(author) if isinstance(author, str) else author, F.lit("")))
    b = F.lower(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")))
    return ((a == S.LOW_QUALITY_AUTHOR) | F.contains(a, F.lit(S.LOW_QUALITY_AUTHOR_PART))
            | b.isin(S.LOW_QUALITY_BODIES))


def initial_status(author, body) -> Column:
    return F.when(is_low_quality(author, body), F.lit("skipped")).otherwise(F.lit("pending"))


Order = list[tuple[str, bool]]  # (column, descending)


def order_cols(order: Order) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]


def search_order(sort: str = "relevance", base: Order | None = None) -> Order:
    """Order of search results: ``top``/``hot`` by score, ``new`` by creation
    time (both descending), ``relevance`` keeps the source order (``rank``).
    The id ends every order so positions are total."""
    base = base if base is not None else [("rank", False)]
    if sort in ("top", "hot"):
        keys = [("score", True)]
    elif sort == "new":
        keys = [("created_utc", True)]
    elif sort == "relevance":
        keys = []
    else:
        raise ValueError(f"unknown sort {sort!r}")
    return keys + base + [("id", False)]


def with_defaults(posts: DataFrame) -> DataFrame:
    """Missing fields: text -> '', score -> 0, created -> 0.0."""
    fills = {"subreddit": F.lit(""), "title": F.lit(""), "selftext": F.lit(""), "author": F.lit(""),
             "body": F.lit(""), "score": F.lit(0).cast("long"), "created_utc": F.lit(0.0)}
    return posts.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items() if c in posts.columns})


def first_occurrence(cands: DataFrame, order: Order, group: str = "query_id") -> DataFrame:
    """Keep the first row per query and id in ``order`` (ids without value
    dropped). What a query sees does not depend on other queries of the run."""
    valid = cands.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    w = Window.partitionBy(*[c for c in (group, "id") if c in cands.columns]).orderBy(*order_cols(order))
    return valid.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def quota(posts: DataFrame, limit: int, order: Order, group: str = "query_id") -> DataFrame:
    """Keep posts in ``order`` until the usable (not skipped) ones reach
    ``limit``; the post reaching it is kept, later ones are not.

    The cut-off is the order position of the ``limit``-th usable post of
    each group, found with a per-group top-k; groups with fewer usable posts
    keep everything. Cut-offs meet the posts in parts, so a query that holds
    most of the posts is many tasks."""
    names = [c for c, _ in order]
    usable = posts.filter(F.col("status") != "skipped").select(group, *names)
    w = Window.partitionBy(group).orderBy(*order_cols(order))
    cut = (_salted(usable, limit, group, order).withColumn("__rn", F.row_number().over(w))
           .filter(F.col("__rn") == limit)
           .select(F.col(group), *[F.col(c).alias(f"__cut_{c}") for c in names]))
    j = salted_join(posts, cut, group, names).select(*posts.columns, *[c for c in cut.columns if c != group])
    return (j.filter(F.col(f"__cut_{names[-1]}").isNull() | F.coalesce(_not_after(order), F.lit(True)))
            .drop(*[f"__cut_{c}" for c in names]))


def _not_after(order: Order) -> Column:
    """Row is at or before the cut-off row in a lexicographic order."""
    cond = F.lit(True)
    for name, desc in reversed(order):
        v, cut = F.col(name), F.col(f"__cut_{name}")
        # nulls as in the sort: first where ascending, last where descending
        before = F.coalesce((v > cut) if desc else (v < cut),
                            (v.isNotNull() & cut.isNull()) if desc else (v.isNull() & cut.isNotNull()))
        cond = before | (v.eqNullSafe(cut) & cond)
    return cond


def _salted(df: DataFrame, k: int, group: str, order: Order) -> DataFrame:
    """Rows that can be among the first ``k`` of their group: the first k of
    each part of it (all the same, and planned by Spark, for small k)."""
    if k <= PARTIAL_K:
        return df
    salt = F.pmod(F.xxhash64(*[c for c, _ in order]), F.lit(SALTS))
    w = Window.partitionBy(group, "__salt").orderBy(*order_cols(order))
    return (df.withColumn("__salt", salt).withColumn("__part", F.row_number().over(w))
            .filter(F.col("__part") <= k).drop("__salt", "__part"))


#: Comments of a thread: as listed, or for archive layouts by score.
THREAD_ORDER: Order = [("pos", False), ("id", False)]
ARCHIVE_ORDER: Order = [("score", True), ("pos", False), ("id", False)]


def first_k(df: DataFrame, k: int, group: str, order: Order) -> DataFrame:
    """First ``k`` rows per group in ``order``, for any k."""
    df = _salted(df, k, group, order)
    w = Window.partitionBy(group).orderBy(*order_cols(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def ingest_posts(cands: DataFrame, stored: DataFrame | None = None, post_limit: int = S.DEFAULT_POST_LIMIT,
                 fill_post_limit: bool = True, skip_existing: bool = True,
                 order: Order | None = None) -> DataFrame:
    """Posts to store from a run's candidates.

    Without fill only the first ``post_limit`` candidates of each query are
    looked at (one page). Then: first occurrence per id; with
    ``skip_existing`` ids already in ``stored`` are left out; status by
    quality; with fill, keep until ``post_limit`` usable posts. Output has the
    post columns plus ``query_id``."""
    order = order or search_order()
    c = with_defaults(cands)
    if not fill_post_limit:
        c = first_k(c, post_limit, "query_id", order)
    c = first_occurrence(c, order)
    if skip_existing and stored is not None:
        c = c.join(stored.select("id"), "id", "left_anti")
    c = c.withColumn("status", initial_status("author", "selftext"))
    if fill_post_limit:
        c = quota(c, post_limit, order)
    return c


def ingest_comments(comment_cands: DataFrame, kept_posts: DataFrame,
                    comment_limit: int = S.DEFAULT_COMMENT_LIMIT, order: Order | None = None,
                    kind_filter: bool = True) -> DataFrame:
    """Comments of the kept posts: ``kind = 't1'`` first (direct layouts),
    then the first ``comment_limit`` per post (skipped ones count), status by
    quality."""
    c = with_defaults(comment_cands)
    if kind_filter and "kind" in c.columns:
        c = c.filter(F.col("kind") == "t1")
    c = c.join(kept_posts.select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi")
    c = first_k(c, comment_limit, "post_id", order or THREAD_ORDER)
    return c.withColumn("status", initial_status("author", "body"))


def ingest_counters(cands: DataFrame, stored: DataFrame | None, kept: DataFrame) -> DataFrame:
    """Per query: posts added, usable among them, and existing ones skipped."""
    added = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("added"),
                                         F.count_if(F.col("status") != "skipped").alias("usable"))
    if stored is None:
        return added.withColumn("skipped_existing", F.lit(0).cast("long"))
    first = first_occurrence(cands, search_order())
    existing = (first.join(stored.select("id"), "id", "left_semi")
                .groupBy("query_id").agg(F.count(F.lit(1)).alias("skipped_existing")))
    return (added.join(existing, "query_id", "full")
            .select("query_id", F.coalesce("added", F.lit(0)).alias("added"),
                    F.coalesce("usable", F.lit(0)).alias("usable"),
                    F.coalesce("skipped_existing", F.lit(0)).alias("skipped_existing")))


def to_post_rows(kept: DataFrame) -> DataFrame:
    return kept.select(*[F.col(f.name).cast(f.dataType) for f in S.POSTS.fields])


def to_comment_rows(kept: DataFrame) -> DataFrame:
    return kept.select(*[F.col(f.name).cast(f.dataType) for f in S.COMMENTS.fields])
