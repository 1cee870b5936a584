"""Quality rules on repetition, by suffix arrays of words.

All texts of a slice are laid end to end and get one suffix array, in which
the document is the first part of every key, so a match never crosses
documents. Prefix doubling keeps its ranks of every level; they give the
longest common prefix (LCP) of neighbours in the array. The larger LCP of a
suffix with its two neighbours is the value of the innermost LCP interval that
holds it: the longest string from there that the document repeats. Uniting
``[i, i + LCP)`` over all suffixes with an LCP of ``min_repeat`` or more gives
the union of all maximal repeats of at least that many words.

Rows are judged one by one: repeated rows or ids each get their own equal
verdict. A null or empty text has no words and fails the base rule. An empty
table gives an empty result; other columns are passed by ``keep_clean`` and
left out by ``repetition_report``, whatever their names are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from themeflow.llm.arrowtext import WORD_SPACE, split_words, text_slices, word_ids

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionLimits:
    """``min_words`` and ``max_window_percent`` are the base rule; a document
    also fails if repeats of ``min_repeat`` or more words cover over
    ``max_covered`` of it, or one repeat has over ``max_longest`` words."""
    min_words: int = 50
    max_window_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 200


def longest_repeats(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every word position, the length of the longest string from there
    that starts at another place of the same document too. ``ids`` are the
    words of all documents end to end, ``counts`` their number in each."""
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    _, first = np.unique(doc * (ids.max() + 1) + ids, return_inverse=True)
    size = np.bincount(first)
    start = np.cumsum(size) - size
    rank = start[first].astype(np.int64)
    levels, active, step = [rank.astype(np.int32)], np.flatnonzero(size[first] > 1), 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        old = rank[active]
        new_class = np.r_[True, old[1:] != old[:-1]]
        new_sub = new_class | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        class_at = np.maximum.accumulate(np.where(new_class, at, 0))
        sub_at = np.maximum.accumulate(np.where(new_sub, at, 0))
        rank = rank.copy()
        rank[active] = old + sub_at - class_at
        sub_size = np.bincount(np.cumsum(new_sub) - 1)
        active = active[sub_size[np.cumsum(new_sub) - 1] > 1]
        levels.append(rank.astype(np.int32))
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[near], right[near]
    lcp = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ia, ib = a + lcp, b + lcp
        inside = (ia < end[a]) & (ib < end[b])
        same = inside & (levels[k][np.minimum(ia, n - 1)] == levels[k][np.minimum(ib, n - 1)])
        lcp += same * (1 << k)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _duplicate_lines(text: str) -> int:
    lines = Counter(text.split("\n"))
    return sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(WORD_SPACE))


def measure(texts: pa.Array, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """The measures and the verdict of each text, as columns."""
    words, counts = split_words(texts)
    counts = counts.astype(np.int64)
    n = len(words)
    best = longest_repeats(word_ids(words), counts)
    window = np.flatnonzero(best >= 3)
    in_window = covered(window, np.full(len(window), 3), n)
    long = np.flatnonzero(best >= limits.min_repeat)
    in_long = covered(long, best[long], n)
    longest = np.zeros(len(counts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(counts)), counts), best)
    plain = [t or "" for t in texts.to_pylist()]
    space = np.fromiter((sum(t.count(c) for c in WORD_SPACE) for t in plain), np.int64, len(plain))
    out = {
        "n_words": counts,
        "word_chars": np.fromiter(map(len, plain), np.int64, len(plain)) - space,
        "n_symbols": np.fromiter((sum(t.count(c) for c in SYMBOLS) for t in plain), np.int64, len(plain)),
        "n_dup_lines": np.fromiter(map(_duplicate_lines, plain), np.int64, len(plain)),
        "n_repeat_words": _per_doc(in_window, counts),
        "covered_words": _per_doc(in_long, counts),
        "longest_repeat": longest,
    }
    out["base_failed"] = (counts < limits.min_words) | (
        100 * out["n_repeat_words"] > limits.max_window_percent * counts)
    out["kept"] = ~(out["base_failed"] | (out["covered_words"] > limits.max_covered * counts)
                    | (longest > limits.max_longest))
    return out


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "covered_words", "longest_repeat")


def repetition_report(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(),
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measures and the verdict."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [
        T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in _COLUMNS])

    def judge(batches):
        for part in text_slices(batches, text_col):
            got = measure(part.column(text_col), limits)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col)] + [pa.array(got[c]) for c in _COLUMNS], [id_col, *_COLUMNS])

    return docs.select(id_col, text_col).mapInArrow(judge, schema)


def keep_clean(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(),
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    def keep(batches):
        for part in text_slices(batches, text_col):
            yield part.filter(pa.array(measure(part.column(text_col), limits)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
