import random

import numpy as np
import pytest
from helpers import sorted_rows

from themeflow.llm.suffix_index import SuffixSettings, brute_force, digest, remove_repeats, rolling, sliding_min

TINY = SuffixSettings(chunk_bytes=1 << 14, bucket_keys=500)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_hashes_and_minima():
    data = np.frombuffer(b"abcabcabcabd" * 5, np.uint8)
    for width in (1, 2, 5, 7, 31):
        h = rolling(data, width)
        same = {}
        for i in range(len(data) - width + 1):
            same.setdefault(data[i:i + width].tobytes(), set()).add(int(h[i]))
        assert all(len(v) == 1 for v in same.values()) and len({*map(min, same.values())}) == len(same)
        v = np.random.default_rng(0).integers(0, 99, 80)
        assert sliding_min(v, width).tolist() == [v[i:i + width].min() for i in range(80 - width + 1)]
    assert len(rolling(data, 100)) == 0


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_equals_brute_force(spark, batches):
    rng = random.Random(batches)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(12)]
    rows = [(i, rng.choice(base)[rng.randrange(200):][:rng.randrange(30, 200)] + rng.choice(base)[:rng.randrange(99)])
            for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a" * 49), (903, "a" * 50), (904, "a" * 300), (905, "ab" * 90), (906, "ab" * 80),
             (-7, base[0]), (907, base[0])]
    s = SuffixSettings(chunk_bytes=TINY.chunk_bytes, bucket_keys=TINY.bucket_keys, n_batches=batches)
    assert sorted_rows(digest(remove_repeats(docs(spark, rows), s))) == sorted(brute_force(rows), key=str)


def test_a_match_of_the_least_length_at_any_place(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(40):
        shared = letters(50 if i % 2 else 49)
        rows += [(2 * i, letters(i) + shared + letters(40 - i)), (2 * i + 1, letters(7 * i % 40) + shared + letters(9))]
    got = {r.doc_id: r.n_removed for r in digest(remove_repeats(docs(spark, rows), TINY)).collect()}
    assert got == {r[0]: r[2] for r in brute_force(rows)}
    # a neighbouring letter may agree by chance
    assert all(got[d] >= 50 if d % 4 == 3 else got[d] < 2 or got[d] >= 50 for d in range(80))


def test_spans_and_kept_bytes(spark):
    long = "The passage that two documents share, of more than fifty bytes in all."
    rows = [(1, "x" + long), (2, "before " + long + " between " + long + " after"), (3, "y" + long + long)]
    got = {r.doc_id: r for r in remove_repeats(docs(spark, rows), TINY).collect()}
    assert bytes(got[2].kept) == b"before  between  after" and len(got[2].spans) == 2
    assert bytes(got[3].kept) == b"y" and [tuple(s) for s in got[3].spans] == [(1, 1 + 2 * len(long))]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted_rows(digest(remove_repeats(odd_docs, TINY))) == sorted(brute_force(rows), key=str)
    assert remove_repeats(no_docs, TINY).count() == 0
    long = "0123456789" * 6
    nulls = docs(spark, [(None, long), (None, long), (1, long)])
    assert sorted_rows(digest(remove_repeats(nulls, TINY)).select("doc_id", "n_removed")) == sorted(
        [(None, 0), (None, 0), (1, 60)], key=str)
