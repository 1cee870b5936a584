import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import sorted_rows

from themeflow.llm import jaccard_join as J
from themeflow.llm.components import connected_components


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_copies(n, seed, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(40)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    texts = near_copies(60, 1) + near_copies(30, 2, 200) + near_copies(20, 3, 9) + [
        None, "", "  ", "one", "One", "two words", "two words", "a b c d", "a b c d e", "\x1c a b c", "a b c"]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    assert sorted_rows(J.similar_documents(docs(spark, rows))) == sorted(J.brute_force(rows), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted_rows(J.similar_documents(df)) == sorted(J.brute_force(rows), key=str)


def test_the_bound_is_inclusive(spark):
    # 20 shared shingles of 17 / 20 = 0.85: sets of 20 and 17 nested
    long = " ".join(f"t{i}" for i in range(23))
    short = " ".join(f"t{i}" for i in range(20))
    less = " ".join(f"t{i}" for i in range(19))
    got = {r.doc_id: r.component_id for r in J.similar_documents(docs(spark, [(1, long), (2, short)])).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.doc_id: r.component_id for r in J.similar_documents(docs(spark, [(1, long), (2, less)])).collect()}
    assert got == {1: 1, 2: 2}


def test_any_order_shares_a_prefix_token():
    rng = np.random.default_rng(3)
    for n in (1, 3, 7, 20, 200):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(0.15 * n)
        b = np.sort(a[drop:])
        common, how = a[::3].copy(), np.arange(len(a[::3])) + 5
        for salt in (0, 1, 2):
            for table in ((None, None), (common, how)):
                assert len(np.intersect1d(J.prefix(a, 85, salt, *table), J.prefix(b, 85, salt, *table)))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n, m in ((50, 45), (3000, 3500), (30000, 17000), (300, 20000)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 63, m).astype(np.uint64) * np.uint64(2)])
        apart = len(np.setxor1d(a, b))
        assert J.fine_gap(J.sketch(a, J.fine_parts(len(a))), J.sketch(b, J.fine_parts(len(b)))) <= apart
        assert J.fine_gap(J.sketch(a, J.PARTS), J.sketch(b, J.PARTS)) <= apart
        assert J.fine_gap(J.sketch(a, J.dense_parts(len(a))), J.sketch(b, J.dense_parts(len(b)))) <= apart


def test_runs_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 8)
    t = {"token": np.repeat(np.array([1, 2, 3]), [30, 1, 5]), "sid": np.arange(36), "n": np.full(36, 10, np.int32),
         "comp": np.arange(36), "sketch": np.zeros((36, J.PARTS), np.uint8)}
    pairs = {(int(a), int(b)) for r in J._cross_pairs(t, 85) for a, b in zip(r.column("a"), r.column("b").to_pylist())
             for a in [a.as_py()]}
    assert len(pairs) == 30 * 29 // 2 + 10
    hubs = {(a, b) for r in J._hub_pairs(t, 1, 85) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())}
    assert len(hubs) == 29 + 4 and hubs <= pairs
    batches = [pa.record_batch({"token": t["token"][i:i + 7], "n": t["n"][i:i + 7]}) for i in range(0, 36, 7)]
    seen = [list(map(int, p["token"])) for p in J._whole_runs(batches)]
    assert [x for p in seen for x in p] == t["token"].tolist() and not any(
        p[-1] == q[0] for p, q in zip(seen, seen[1:]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (-5, 200), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(chain, "a long, b long")).read().collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == 1 and got[200] == -5 and got[302] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).read().count() == 0


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    out = sorted_rows(J.similar_documents(odd_docs))
    assert len(out) == odd_docs.count()
    got = {r[0]: r[1:] for r in out}
    assert got[0] == (0, 0) and got[3] == (1, 3) and got[4] == (1, 3) and got[50] == (1, 5) and got[51] == (1, 9)
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [
        0, 1, 2, 3, 5, 7, 8, 9, 10, 11]      # one of the rows with id 50 is like row 5, and so on
    assert J.similar_documents(no_docs).count() == 0 and J.one_of_each(no_docs).count() == 0
    nulls = docs(spark, [(None, "a b c d e"), (4, "a b c d e"), (4, "p q r s")])
    assert sorted_rows(J.similar_documents(nulls)) == sorted([(None, 2, None), (4, 2, None), (4, 1, 4)], key=str)


@pytest.mark.parametrize("percent", [80, 100])
def test_other_settings(spark, percent):
    rows = list(enumerate(near_copies(40, 6, 30)))
    got = sorted_rows(J.similar_documents(docs(spark, rows), J.JoinSettings(k=2, percent=percent)))
    assert got == sorted(J.brute_force(rows, 2, percent), key=str)


def test_long_runs_are_dealt_out(spark):
    texts = near_copies(150, 11) + near_copies(80, 12, 200) + near_copies(30, 13)
    # a chain: neighbours are alike, the ends are not
    base = [f"c{i}" for i in range(120)]
    for i in range(25):
        base[i * 4] = f"d{i}"
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    random.Random(6).shuffle(rows)
    got = J.similar_documents(docs(spark, rows), J.JoinSettings(run_limit=8))
    assert sorted_rows(got) == sorted(J.brute_force(rows), key=str)


def test_long_runs_lie_in_many_tasks(spark):
    n, limit = 4000, 100
    rows = spark.range(n).selectExpr("7L as token", "id as sid", "100 as n", "cast('' as binary) as sketch",
                                     "if(id % 20 = 0, id, 1L) as comp")
    s = J.JoinSettings(run_limit=limit)
    assert [r.token for r in J.long_tokens(rows.coalesce(1), s).collect()] == [7]
    assert J.long_tokens(rows.limit(limit // 2 - 1).coalesce(1), s).count() == 0
    shares = J.run_shares(rows)
    assert [tuple(r) for r in shares.collect()] == [(7, 1, n, n // 20)]
    dealt = J.long_pieces(rows, shares, s).groupBy("token").count().collect()
    assert len(dealt) == 2 * 40 and max(r["count"] for r in dealt) < 4 * limit
    # what lies outside goes to all pieces, the rest to the two outer ones
    assert sum(r["count"] for r in dealt) == 2 * n + 40 * (n // 20)


def test_one_component_makes_no_pairs(monkeypatch):
    n, outside = 2000, 3
    made = []
    real = J._partners
    monkeypatch.setattr(J, "_partners", lambda a, b: [made.append(len(i)) or (i, j) for i, j in real(a, b)])
    t = {"token": np.repeat(np.arange(2), n), "sid": np.arange(2 * n), "n": np.full(2 * n, 50, np.int32),
         "sketch": np.zeros((2 * n, J.PARTS), np.uint8), "comp": np.repeat([-1, -2], n)}
    t["comp"][[5, 700, n - 1]] = [5, 700, n - 1]
    pairs = {p for b in J._cross_pairs(t, 85) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())}
    assert pairs == {(min(o, k), max(o, k)) for o in (5, 700, n - 1) for k in range(n) if k != o}
    assert sum(made) <= outside * n


def test_rows_without_copies_stay_whatever_their_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, "a b c d e"), (None, "p q r s t"), (7, "f g h i j"), (7, "k l m n o"),     # no two alike
            (3, ""), (3, ""), (None, None), (4, " "), (4, None),                              # without words
            (9, words), (8, words), (8, words), (10, words + " more"), (11, "one two"), (11, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS id", "2 AS print", "3 AS __id")
    out = J.one_of_each(df)
    assert out.columns == df.columns
    want = rows[:9] + [(8, words), (11, "one two")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_null_id_is_the_smallest_of_its_group(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    assert [tuple(r) for r in J.one_of_each(docs(spark, rows)).collect()] == [(None, "a b c d e f")]


def test_rounds_of_best_pairs_and_turns_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAST_VERIFIED", 500)
    rows = list(enumerate(near_copies(80, 21) + near_copies(30, 22, 150)))
    got = J.similar_documents(docs(spark, rows), J.JoinSettings(k=5, percent=80, best_rounds=2))
    assert sorted_rows(got) == sorted(J.brute_force(rows, 5, 80), key=str)
