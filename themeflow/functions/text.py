"""Scalar text and number expressions shared by every job.

All functions take and return ``pyspark.sql.Column`` objects, so they stay in
whole-stage code generation and are pushed wherever Catalyst likes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeflow import schemas as S

# Control characters C0, DEL and C1 become a blank before whitespace folding.
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f]"
# (?U) makes \s Unicode-aware (NBSP, U+2000..U+200A, U+3000, ...), as in Python.
UNICODE_SPACE_RUN = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_bucket(x) -> Column:
    """Nearest of the five sentiment values; the first (lowest) wins ties.

    NaN, infinities and magnitudes where every distance rounds equal map to
    -1.0, exactly like a first-minimum scan. Spark orders NaN above every
    number and NaN = NaN, so the comparisons below keep that rule."""
    x = _col(x).cast("double")
    d = [F.abs(F.lit(b) - x) for b in S.SENTIMENT_BUCKETS]
    expr = None
    for i, b in enumerate(S.SENTIMENT_BUCKETS[:-1]):
        cond = None
        for j in range(i + 1, len(d)):
            c = d[i] <= d[j]
            cond = c if cond is None else (cond & c)
        expr = (F.when(cond, F.lit(b)) if expr is None else expr.when(cond, F.lit(b)))
    expr = expr.otherwise(F.lit(S.SENTIMENT_BUCKETS[-1]))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(expr)


def sentiment_label(bucket) -> Column:
    expr = None
    for b, name in S.SENTIMENT_LABELS.items():
        cond = _col(bucket) == F.lit(b)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _fold_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CONTROL_CHARS, " "), UNICODE_SPACE_RUN, " ")


def strip_space(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), EDGE_SPACE, "")


def clean_label_text(c) -> Column:
    """Clean a theme label: controls -> blank, fold whitespace, strip blanks,
    quotes, backticks and ``.,;:-`` at both ends. Null -> ''."""
    c = _col(c)
    return F.coalesce(F.btrim(_fold_space(c), F.lit(S.LABEL_STRIP_CHARS)), F.lit(""))


def clean_explanation_text(c) -> Column:
    """Like ``clean_label_text`` but strips only blanks, quotes and backticks."""
    c = _col(c)
    return F.coalesce(F.btrim(_fold_space(c), F.lit(S.EXPLANATION_STRIP_CHARS)), F.lit(""))


def clean_text(c, default: str = "") -> Column:
    """Fold controls and whitespace, strip; empty or null -> ``default``."""
    cleaned = F.btrim(_fold_space(_col(c)), F.lit(" "))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def clean_label(c) -> Column:
    """Report label: as ``clean_text`` with default ``Unclustered``."""
    return clean_text(c, S.UNCLUSTERED)


def is_generic_label(c) -> Column:
    """Empty after cleaning, or a placeholder such as ``Cluster 12``."""
    cleaned = F.lower(clean_label_text(c))
    return (cleaned == F.lit("")) | cleaned.rlike("^" + S.GENERIC_LABEL_PATTERN + "$")


def strip_fence(c) -> Column:
    """Drop a Markdown code fence around a model response.

    If the stripped text starts with three backticks, its first line goes, and
    its last line goes when that line starts with three backticks too. A fenced
    text of a single line has nothing after the first line: null, which
    callers treat as a parse failure. The text is bound once in a lambda so
    the expression does not repeat it."""
    def body(t: Column) -> Column:
        rest = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)\z", 1)
        inner = strip_space(F.regexp_replace(rest, r"(?s)(\A|\n)```[^\n]*\z", ""))
        return (F.when(~t.startswith("```"), t)
                .when(F.instr(t, "\n") > 0, inner))
    return F.transform(F.array(strip_space(_col(c))), body)[0]


def trimmed_concat(*cols, sep: str = " ") -> Column:
    """``f"{a} {b}".strip()`` with nulls as empty text."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return strip_space(F.concat_ws(sep, *parts))


def percent_1dp(x) -> Column:
    """Percent with one decimal, half-even on exact binary ties."""
    return F.bround(_col(x), 1)


def vector_from_json(c) -> Column:
    return F.from_json(_col(c), "array<float>")


def vector_to_json(c) -> Column:
    return F.to_json(_col(c))


def epoch_seconds(ts) -> Column:
    """Wall-clock timestamp (parquet TIMESTAMP without zone, read as
    TIMESTAMP_NTZ) -> epoch seconds as double, read as UTC whatever the
    session time zone is."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              _col(ts).cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(1_000_000.0)


def nocase(c) -> Column:
    """Case-insensitive ordering key."""
    return F.lower(_col(c))
