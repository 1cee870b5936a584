import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import sorted_rows

from themeflow.llm.queries import QUERIES
from themeflow.llm.repetition import RepetitionLimits, keep_clean, longest_repeats, measure, repetition_report


def naive_repeats(words):
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def naive_report(text, limits=RepetitionLimits()):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    best, n = naive_repeats(words), len(words)
    cover = lambda least, most: sum(any(best[i] >= least and i <= p < i + min(best[i], most) for i in range(n))
                                    for p in range(n))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    window, long, longest = cover(3, 3), cover(limits.min_repeat, n), max(best, default=0)
    failed = n < limits.min_words or 100 * window > limits.max_window_percent * n
    kept = not (failed or long > limits.max_covered * n or longest > limits.max_longest)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, window, failed, kept, long, longest)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_equals_naive(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(1 + seed) for _ in range(rng.randrange(40))] for _ in range(30)] + [[], [1], [1] * 37]
    got = longest_repeats(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]))
    assert got.tolist() == [x for d in docs for x in naive_repeats(d)]


def test_long_repeats_and_very_long_text():
    text = " ".join(f"w{i}" for i in range(300))
    got = measure(pa.array([text + " " + text, "a " * 50000, " ".join(f"v{i}" for i in range(80000))]), RepetitionLimits())
    assert got["longest_repeat"].tolist() == [300, 49999, 0]
    assert got["covered_words"].tolist() == [600, 50000, 0] and got["kept"].tolist() == [False, False, True]


def test_report_equals_naive(spark, odd_docs):
    rng = random.Random(9)
    rows = [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "de", "f#", "g|"]) if rng.random() < 0.5 else
                              f"u{rng.randrange(99)}" for _ in range(rng.randrange(30, 120))).replace("de ", "de\n"))
            for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(repetition_report(df)) == sorted(((d, *naive_report(t)) for d, t in rows), key=str)
    short = odd_docs.filter("length(coalesce(text, '')) < 3000")
    assert sorted_rows(repetition_report(short)) == sorted(
        ((r.doc_id, *naive_report(r.text)) for r in short.collect()), key=str)


def test_kept_rows_keep_all_columns(spark, odd_docs, no_docs):
    good = " ".join(f"w{i}" for i in range(60))
    df = odd_docs.unionByName(spark.createDataFrame([(90, good, None, 1, "k"), (None, good, "s", None, None)],
                                                    odd_docs.schema))
    kept = keep_clean(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["90", "None"]
    assert keep_clean(no_docs).count() == 0 and repetition_report(no_docs).count() == 0


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") < 1500:
            assert got[r.doc_id] == naive_report(r.text)
