import os
import time

import numpy as np
import pyarrow as pa
import pytest

from themeflow.llm import interpolated_lm as L
from themeflow.llm import stored
from themeflow.llm.packed import pack, unpack

TINY = L.LmSettings(chunk_bytes=1 << 14, bucket_keys=3000)


def scored(df, monkeypatch, s=TINY):
    learned = []
    learn = L.learn_weights
    monkeypatch.setattr(L, "learn_weights", lambda c, x: learned.append(learn(c, x)) or learned[-1])
    return L.score_documents(df, s).collect(), learned[0]


def compare(rows, got, weights, s=TINY):
    want = {}
    for x in L.brute_force(rows, s):
        want.setdefault(x[0], []).append(x)
    assert len(got) == len(rows)
    for r in got:
        x = next(x for x in want[r.doc_id] if (x[2], x[3]) == (r.n_tokens, r.n_known))
        assert (r.held_out, r.train_tokens) == (x[1], x[4]) and r.base_score == pytest.approx(x[5])
        bucket = L.context_bucket(np.array([p[0] for p in x[6]]))
        p = sum(weights[bucket, k] * np.array([part[3 - k] for part in x[6]]) for k in range(3))
        assert r.score == pytest.approx(np.log10(p).sum())


def test_scores_equal_brute_force(spark, odd_docs, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(10 ** 6, None), (10 ** 6 + 1, ""), (None, "A b")], "doc_id long, text string"))
    got, weights = scored(df, monkeypatch)
    compare([tuple(r) for r in df.collect()], got, weights)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)     # better on texts it never saw


def test_the_model_is_a_distribution(spark, monkeypatch):
    """Over all next words of a context, and one unknown, p adds up to 1."""
    rows = [(i, "a b c a b d a c") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, w = scored(df, monkeypatch)
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6)


def test_weights_are_those_of_plain_em():
    """EM over the histogram equals EM over the bigrams one by one, where
    steps of the histogram are fine."""
    rng = np.random.default_rng(1)
    s = L.LmSettings(log_step=1e-4, em_rounds=200)
    two, one = rng.random(500) * (rng.random(500) > 0.4), rng.random(500) * 0.1
    mass, v = rng.integers(1, 9, 500).astype(float), 50
    cells = pa.table({"bucket": np.full(500, 3, np.int32), "two": L._steps(two, v, s.log_step),
                      "one": L._steps(one, v, s.log_step), "weight": mass})
    weights = np.full(3, 1 / 3)
    p = np.stack([np.full(500, 1 / (v + 1)), one, two], axis=1)
    for _ in range(200):
        share = p * weights
        share *= (mass / share.sum(axis=1))[:, None]
        weights = share.sum(axis=0) / mass.sum()
    assert np.allclose(L.learn_weights(cells, s)[3], weights, atol=2e-3)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    got, weights = scored(odd_docs, monkeypatch)
    compare([(r.doc_id, r.text) for r in odd_docs.collect()], got, weights)
    assert L.score_documents(no_docs).count() == 0


def test_shuffles_go_with_their_query(spark, monkeypatch):
    """Without any garbage collection the shuffles of both stored steps are
    gone when the weights are learned; three small sums may be left."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        names = [f for top in folders for _, _, files in os.walk(top) for f in files]
        return {f.split("_")[1] for f in names if f.startswith("shuffle_")}

    before, left, learn = shuffles(), [], L.learn_weights

    def counted(cells, s):
        for _ in range(50):
            left.append(len(shuffles() - before))
            if left[-1] <= 3:
                break
            time.sleep(0.2)
        return learn(cells, s)

    monkeypatch.setattr(L, "learn_weights", counted)
    monkeypatch.setattr(L, "free_shuffles", lambda spark: None)
    monkeypatch.setattr(stored, "free_shuffles", lambda spark: None)
    df = spark.createDataFrame([(i, f"a b w{i % 50} v{i}") for i in range(400)], "doc_id long, text string")
    assert L.score_documents(df, TINY).count() == 400
    assert left[-1] <= 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_without_training_texts(spark):
    held = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    for r in L.score_documents(df).collect():
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 and np.isfinite(r.score)


def test_packing():
    for a in (np.arange(1000, dtype=np.uint64) << np.uint64(50), np.array([], np.int64), np.array([-1, 5], np.int64),
              np.array([3], np.uint8)):
        assert unpack(pack(a), a.dtype).tolist() == a.tolist()
