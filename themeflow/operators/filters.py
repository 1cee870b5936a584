"""Row predicates of the reports, queues and listings."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.functions.text import clean_label


def theme_row_predicate(columns: list[str], include_reaction_only: bool = False,
                        include_unclustered: bool = False) -> Column:
    """Rows that count towards the theme exports.

    Tag present and not blank; unless asked, not ``unclustered``; unless asked,
    substantive (on a layout without the flag: raw tag is not ``reaction
    only``). A null flag does not pass ``is_substantive = true``."""
    tag = F.col("consolidated_tag")
    cond = tag.isNotNull() & (F.trim(tag) != "")
    if not include_unclustered:
        cond = cond & (F.lower(F.trim(tag)) != "unclustered")
    if not include_reaction_only:
        if "is_substantive" in columns:
            cond = cond & (F.col("is_substantive") == F.lit(True))
        else:
            cond = cond & (F.lower(F.trim(F.col("raw_tag"))) != "reaction only")
    return cond


def theme_rows(ann: DataFrame, include_reaction_only: bool = False,
               include_unclustered: bool = False) -> DataFrame:
    required = {"consolidated_tag"} | ({"raw_tag"} if "is_substantive" not in ann.columns else set())
    missing = required - set(ann.columns)
    if missing:
        raise ValueError(f"annotation table lacks columns {sorted(missing)}")
    return ann.filter(theme_row_predicate(ann.columns, include_reaction_only, include_unclustered))


def chart_theme_rows(ann: DataFrame) -> DataFrame:
    """Charts: substantive (null counts as not) and a real cleaned theme."""
    return ann.filter(F.coalesce(F.col("is_substantive"), F.lit(False))
                      & (clean_label("consolidated_tag") != S.UNCLUSTERED))


def status_filter(df: DataFrame, status: str = "All") -> DataFrame:
    """Listing filter; ``All`` keeps everything, otherwise lower-case match."""
    if status == "All":
        return df
    return df.filter(F.col("status") == status.lower())


def work_queue(df: DataFrame, force: bool = False) -> DataFrame:
    """Items to annotate: pending, plus processed ones when forced."""
    wanted = ["pending", "processed"] if force else ["pending"]
    return df.filter(F.col("status").isin(wanted))


def drop_missing_ids(df: DataFrame) -> DataFrame:
    return df.filter(F.col("id").isNotNull() & (F.col("id") != ""))


def community_filter(df: DataFrame, communities: str | list[str] | None) -> DataFrame:
    """Comma list of communities (trimmed); none or empty keeps all."""
    if not communities:
        return df
    names = communities.split(",") if isinstance(communities, str) else communities
    names = [n.strip() for n in names if n and n.strip()]
    return df.filter(F.col("subreddit").isin(names)) if names else df


def time_filter(df: DataFrame, window: str, as_of: float, before: float | None = None,
                ts_col: str = "created_utc") -> DataFrame:
    """``day/week/month/year`` = the last 1/7/30/365 days before ``as_of``
    (epoch seconds, passed explicitly so results are reproducible); ``all``
    has no lower bound. ``before`` is an exclusive upper bound."""
    out = df
    if window in S.TIME_FILTER_SECONDS:
        out = out.filter(F.col(ts_col) >= F.lit(float(int(as_of) - S.TIME_FILTER_SECONDS[window])))
    elif window != "all":
        raise ValueError(f"unknown time filter {window!r}")
    if before is not None:
        out = out.filter(F.col(ts_col) < F.lit(float(before)))
    return out


def search_predicate(all_of=(), any_of=(), none_of=(), fields=("title", "selftext")) -> Column:
    """Boolean text search ``(a AND b) AND (x OR y) NOT (p OR q)`` over the
    lower-cased concatenation of ``fields`` (case-insensitive substrings)."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))

    def has(term: str) -> Column:
        return F.contains(hay, F.lit(term.lower()))

    cond = F.lit(True)
    if all_of:
        cond = cond & reduce(lambda a, b: a & b, [has(t) for t in all_of])
    if any_of:
        cond = cond & reduce(lambda a, b: a | b, [has(t) for t in any_of])
    if none_of:
        cond = cond & ~reduce(lambda a, b: a | b, [has(t) for t in none_of])
    return cond


def search_items(df: DataFrame, all_of=(), any_of=(), none_of=(), fields=("title", "selftext")) -> DataFrame:
    return df.filter(search_predicate(all_of, any_of, none_of, fields))


_TOKEN = re.compile(r'\s*(?:([(){}])|"([^"]*)"|(\S+?)(?=[(){}\s"]|$))')


def parse_search(expression: str) -> Callable[[Callable[[str], Column]], Column]:
    """A predicate builder for ``{a AND b} AND (x OR y) NOT (p OR q)``.

    AND, OR and NOT are upper-case words; terms side by side are joined by
    AND, and ``x NOT y`` reads ``x AND NOT y``. NOT binds before AND, AND before
    OR; braces group as parentheses do; quotes keep a phrase together. Returns
    a function of ``has(term) -> Column``; an empty expression finds all."""
    tokens = []
    at = 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if m is None:
            raise ValueError(f"cannot read the search at {expression[at:]!r}")
        mark, phrase, word = m.groups()
        if mark:
            tokens.append("(" if mark in "({" else ")")
        elif phrase is None and word in ("AND", "OR", "NOT"):
            tokens.append(word)
        else:
            tokens.append(("term", word if phrase is None else phrase))
        at = m.end()
    tokens.append("end")
    place = 0

    def take(*wanted) -> bool:
        nonlocal place
        if tokens[place] in wanted:
            place += 1
            return True
        return False

    def alternatives():
        parts = [conjunction()]
        while take("OR"):
            parts.append(conjunction())
        return lambda has: reduce(lambda a, b: a | b, [p(has) for p in parts])

    def conjunction():
        parts = [factor()]
        while take("AND") or tokens[place] in ("NOT", "(") or isinstance(tokens[place], tuple):
            parts.append(factor())
        return lambda has: reduce(lambda a, b: a & b, [p(has) for p in parts])

    def factor():
        nonlocal place
        if take("NOT"):
            inner = factor()
            return lambda has: ~inner(has)
        if take("("):
            inner = alternatives()
            if not take(")"):
                raise ValueError("a bracket of the search is not closed")
            return inner
        token = tokens[place]
        if not isinstance(token, tuple):
            raise ValueError(f"the search lacks a term before {token!r}")
        place += 1
        return lambda has: has(token[1])

    if tokens == ["end"]:
        return lambda has: F.lit(True)
    found = alternatives()
    if not take("end"):
        raise ValueError(f"the search has a loose {tokens[place]!r}")
    return found


def search_expression(df: DataFrame, expression: str, fields=("title", "selftext")) -> DataFrame:
    """Rows whose lower-cased text satisfies a boolean search expression."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return df.filter(parse_search(expression)(lambda term: F.contains(hay, F.lit(term.lower()))))


def pending_queue(items: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` pending items (by id, so the batch is reproducible)."""
    return items.filter(F.col("status") == "pending").orderBy("id").limit(limit)
