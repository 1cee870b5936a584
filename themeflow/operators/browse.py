"""Item listings: filters, theme join, ordering, pages, row selection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators.filters import status_filter
from themeflow.operators.ordering import with_row_index

#: Rows that a top-k keeps in one task, and that are broadcast.
TOP_ROWS = 10_000


def theme_filter(items: DataFrame, annotations: DataFrame, theme: str = "All") -> DataFrame:
    """``All``: no filter; ``None``: items without annotation; otherwise
    items whose annotation has that consolidated tag."""
    if theme == "All":
        return items
    ann_ids = annotations.select(F.col("item_id"))
    if theme == "None":
        return items.join(ann_ids, items.id == ann_ids.item_id, "left_anti")
    hit = annotations.filter(F.col("consolidated_tag") == theme).select("item_id")
    return items.join(hit, items.id == hit.item_id, "left_semi")


def listing_order():
    return [F.col("created_utc").desc(), F.col("id").asc()]


def snippet(c) -> "F.Column":
    """Newlines -> blanks; longer than 45 characters -> first 45 + '...'."""
    flat = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(c) > S.SNIPPET_WIDTH,
                  F.concat(F.substring(flat, 1, S.SNIPPET_WIDTH), F.lit("..."))).otherwise(flat)


def display_rows(items: DataFrame, annotations: DataFrame, item_type: str, *more: str) -> DataFrame:
    """Listing projection: status, id, text snippet and the tag display
    (``'theme'``, else ``raw: 'tag'`` when annotated, else ``None``)."""
    a = annotations.select(F.col("item_id"), F.col("consolidated_tag").alias("__ct"),
                           F.col("raw_tag").alias("__rt"), F.lit(True).alias("__has"))
    j = items.join(a, items.id == a.item_id, "left")
    tag = (F.when(F.coalesce(F.col("__ct"), F.lit("")) != "", F.format_string("'%s'", F.col("__ct")))
           .when(F.col("__has"), F.format_string("raw: '%s'", F.coalesce(F.col("__rt"), F.lit("None"))))
           .otherwise(F.lit("None")))
    text = F.col("title") if item_type == "post" else F.col("body")
    return j.select("id", "status", "created_utc", snippet(text).alias("snippet"), tag.alias("tag_display"), *more)


def listing(items: DataFrame, annotations: DataFrame, item_type: str, status: str = "All",
            theme: str = "All") -> DataFrame:
    """Filtered listing with a global 1-based index in listing order."""
    rows = theme_filter(status_filter(items, status), annotations, theme)
    shown = display_rows(rows, annotations, item_type)
    return with_row_index(shown, listing_order(), name="row_index")


def listing_ranges(items: DataFrame, annotations: DataFrame, item_type: str, ranges: list[tuple[int, int]],
                   status: str = "All", theme: str = "All") -> DataFrame:
    """The rows of ``listing`` with an index in one of the inclusive ranges.

    Only ids and times are ordered: up to ``TOP_ROWS`` by a distributed top-k
    that ends at the last index wanted, beyond by the global index. Texts and
    annotations are fetched for the chosen rows alone."""
    keys = theme_filter(status_filter(items, status), annotations, theme).select("id", "created_utc")
    last = max((hi for _, hi in ranges), default=0)
    if last <= TOP_ROWS:
        w = Window.orderBy(*listing_order())        # over at most ``last`` rows
        indexed = keys.orderBy(*listing_order()).limit(last).withColumn("row_index", F.row_number().over(w).cast("long"))
    else:
        indexed = with_row_index(keys, listing_order(), name="row_index")
    wanted = reduce(lambda a, b: a | b, [F.col("row_index").between(lo, hi) for lo, hi in ranges], F.lit(False))
    chosen = indexed.filter(wanted).select(F.col("id").alias("__id"), "row_index")
    if sum(hi - lo + 1 for lo, hi in ranges) <= TOP_ROWS:
        chosen = F.broadcast(chosen)
    rows = items.join(chosen, F.col("id") == F.col("__id")).drop("__id")
    own = annotations.join(chosen, F.col("item_id") == F.col("__id"), "left_semi")
    return display_rows(rows, own, item_type, "row_index")


def listing_page(items: DataFrame, annotations: DataFrame, item_type: str, page_no: int,
                 page_size: int = S.PAGE_SIZE, status: str = "All", theme: str = "All") -> tuple[DataFrame, int]:
    """One page of a listing, clamped to the last one, and the page count."""
    total = theme_filter(status_filter(items, status), annotations, theme).count()
    pages = max(1, math.ceil(total / page_size))
    p = min(max(1, page_no), pages)
    return listing_ranges(items, annotations, item_type, [((p - 1) * page_size + 1, p * page_size)], status,
                          theme), pages


def listing_selection(items: DataFrame, annotations: DataFrame, item_type: str, selection: str,
                      status: str = "All", theme: str = "All") -> DataFrame:
    """The rows of a listing that a selection like ``5, 12-15`` names."""
    total = theme_filter(status_filter(items, status), annotations, theme).count()
    return listing_ranges(items, annotations, item_type, parse_range_selection(selection, total), status, theme)


def page(listing_df: DataFrame, page_no: int, page_size: int = S.PAGE_SIZE) -> tuple[DataFrame, int]:
    """One page of an indexed listing; the page is clamped to the last one.
    Returns the page rows and the page count (one ``count`` job)."""
    total = listing_df.count()
    pages = max(1, math.ceil(total / page_size))
    p = min(max(1, page_no), pages)
    lo, hi = (p - 1) * page_size + 1, p * page_size
    return listing_df.filter(F.col("row_index").between(lo, hi)), pages


def parse_range_selection(selection: str, max_val: int) -> list[tuple[int, int]]:
    """``5, 12-15, 20`` -> inclusive ranges within 1..max_val.

    Commas or blanks separate parts; a reversed range is swapped; values out
    of range are dropped; malformed parts (``-5``, ``1-2-3``, ``-``) are
    ignored. The string is user input, so this runs on the driver; only the
    ranges (not the rows) are used by the job."""
    out = []
    for part in selection.replace(",", " ").split():
        if "-" in part:
            pieces = part.split("-")
            if len(pieces) != 2:
                continue
            try:
                a, b = int(pieces[0].strip()), int(pieces[1].strip())
            except ValueError:
                continue
            lo, hi = min(a, b), max(a, b)
        else:
            try:
                lo = hi = int(part)
            except ValueError:
                continue
        lo, hi = max(lo, 1), min(hi, max_val)
        if lo <= hi:
            out.append((lo, hi))
    return _merge(out)


def _merge(ranges):
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi))
        else:
            merged.append((lo, hi))
    return merged


def select_rows(indexed: DataFrame, selection: str, max_val: int | None = None,
                index_col: str = "row_index") -> DataFrame:
    """Rows of an indexed listing picked by a range selection string."""
    if max_val is None:
        max_val = indexed.count()
    ranges = parse_range_selection(selection, max_val)
    if not ranges:
        return indexed.limit(0)
    cond = None
    for lo, hi in ranges:
        c = F.col(index_col).between(lo, hi)
        cond = c if cond is None else (cond | c)
    return indexed.filter(cond)
