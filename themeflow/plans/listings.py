"""Registered listings: ordered, indexed, paged and selected items."""

from __future__ import annotations

import uuid

from themeflow.operators import browse as BR
from themeflow.operators.stored_listing import StoredListing
from themeflow.plans import sql as Q
from themeflow.plans.registry import query
from themeflow.session import checkpoint_dir
from themeflow.sources import bindings as B

SELECTION = "5, 12-15, 20 40-35 1-2-3 -5 x"


def _listing_sql(table: str, text: str, where: str = "true") -> str:
    return Q.with_(Q.POSTS, Q.COMMENTS, Q.ANNOTATIONS, f"""lst AS (
  SELECT i.id, i.status, i.created_utc, {Q.snippet('i.' + text)} AS snippet, {Q.tag_display('a')} AS tag_display,
         row_number() OVER (ORDER BY i.created_utc DESC, i.id) AS row_index
  FROM {table} i LEFT JOIN annotations a ON i.id = a.item_id WHERE {where})""")


@query("listing_posts", _listing_sql("posts", "title") + "SELECT * FROM lst")
def q_listing_posts(spark, sf):
    return BR.listing(B.thread_posts(spark, sf), B.thread_annotations(spark, sf), "post")


@query("listing_comments_page", _listing_sql("comments", "body", "i.status = 'processed'")
       + "SELECT * FROM lst WHERE row_index BETWEEN 21 AND 30")
def q_listing_page(spark, sf):
    return BR.listing_page(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), "comment", 3,
                           status="Processed")[0]


@query("listing_comments_selection", _listing_sql("comments", "body")
       + "SELECT * FROM lst WHERE row_index IN (5, 12, 13, 14, 15, 20) OR row_index BETWEEN 35 AND 40")
def q_listing_selection(spark, sf):
    return BR.listing_selection(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), "comment", SELECTION)


@query("listing_comments_deep_selection", _listing_sql("comments", "body")
       + "SELECT * FROM lst WHERE row_index BETWEEN 3 AND 4 OR row_index BETWEEN 5000 AND 5009 OR row_index >= 30000")
def q_listing_deep(spark, sf):
    """Positions beyond a top-k come from the global index."""
    return BR.listing_selection(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), "comment",
                                "5009-5000 3,4 30000-1000000000000")


@query("listing_posts_without_theme", _listing_sql(
    "posts", "title", "i.id NOT IN (SELECT item_id FROM annotations)") + "SELECT * FROM lst")
def q_listing_unthemed(spark, sf):
    return BR.listing(B.thread_posts(spark, sf), B.thread_annotations(spark, sf), "post", theme="None")


@query("listing_comments_of_theme", _listing_sql(
    "comments", "body", "i.id IN (SELECT item_id FROM annotations WHERE consolidated_tag = 'blue rod')")
    + "SELECT * FROM lst")
def q_listing_theme(spark, sf):
    return BR.listing(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), "comment", theme="blue rod")


def _stored(spark, sf) -> StoredListing:
    out = StoredListing(spark, f"{checkpoint_dir(spark).rstrip('/')}/tables/listing-{uuid.uuid4().hex}")
    out.store(B.thread_comments(spark, sf), B.thread_annotations(spark, sf), "comment")
    return out


@query("stored_listing_page", _listing_sql("comments", "body", "i.status = 'processed'")
       + """SELECT lst.* FROM lst, (SELECT least(200, greatest(1, ceil(count(*) / 25.0))) AS p FROM lst)
WHERE row_index BETWEEN (p - 1) * 25 + 1 AND p * 25""")
def q_stored_page(spark, sf):
    """A late page of a listing that is kept in its order."""
    return _stored(spark, sf).page(200, 25, status="Processed")[0]


@query("stored_listing_selection_of_theme", _listing_sql(
    "comments", "body", "i.id IN (SELECT item_id FROM annotations WHERE consolidated_tag = 'blue rod')")
    + "SELECT * FROM lst WHERE row_index IN (5, 12, 13, 14, 15, 20) OR row_index BETWEEN 35 AND 40")
def q_stored_selection(spark, sf):
    return _stored(spark, sf).selection(SELECTION, theme="blue rod")
