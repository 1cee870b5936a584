import numpy as np
import pytest

from themeflow.llm import charpoly, whitening

SMALL = "/root/testdata/sf0.001/embeddings.parquet"


def leverrier(a):
    """Characteristic polynomial by Faddeev and LeVerrier, exact."""
    d = len(a)
    a, one = np.array(a, object).reshape(d, d), np.eye(d, dtype=int).astype(object)
    m, c = np.zeros((d, d), object), [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * one
        c[d - k] = -sum((a @ m)[i, i] for i in range(d)) // k
    return c


def gram(rng, rows, dims, size):
    x = rng.integers(-size, size, (rows, dims)).astype(object)
    return (x.T @ x).tolist()


def matrices():
    rng = np.random.default_rng(0)
    return [gram(rng, 30, 7, 10 ** 6), gram(rng, 3, 6, 9), np.diag([5, 5, 3, 0, 1, 1]).tolist(), [[4]], [[0, 0], [0, 7]],
            np.ones((5, 5), int).tolist()]


@pytest.mark.parametrize("matrix", matrices())
def test_polynomial_roots_and_vectors(matrix):
    poly = charpoly.combine([(p, charpoly.polynomial_mod(matrix, p)) for p in charpoly.moduli(matrix)])
    assert poly == leverrier(matrix)
    a = np.array(matrix, float)
    values = np.sort(np.linalg.eigvalsh(a))[::-1]
    rank = charpoly.positive_roots(poly)
    assert rank == np.linalg.matrix_rank(a)
    trace, seen = sum(matrix[i][i] for i in range(len(matrix))), []
    for nth in range(1, rank + 1):
        low, shift, first, last = charpoly.root_bracket(poly, trace, nth)
        assert first <= nth <= last
        value = (2 * low + 1) / (1 << shift + 1)
        assert value == pytest.approx(values[nth - 1], rel=1e-9)
        v = np.array(charpoly.null_vectors(matrix, low, shift, last - first + 1)[nth - first])
        assert np.abs(a @ v - value * v).max() < 1e-12 * max(1, value)
        seen.append(v)
    assert np.allclose(np.array(seen) @ np.array(seen).T, np.eye(rank), atol=1e-13)


def test_equals_brute_force(spark):
    df = spark.read.parquet(SMALL)
    out = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(1024 * np.stack(df.toPandas().sort_values("vec_id")["embedding"]).astype(float)).astype(int) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    got = out["whitened"].to_numpy().reshape(n, 8)
    want *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-10
    assert np.allclose(out["explained"].to_numpy().reshape(n, 8), values[:8] / values.sum(), rtol=1e-12)
    assert out["deviation"].tolist() == np.repeat(((n * x - total) ** 2).sum(axis=1), 8).tolist()
    assert out["component"].tolist() == list(range(1, 9)) * n and set(out["n"]) == {n}
    error = np.abs(np.cov(got.T, bias=True) - np.eye(8)).max()
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-12 and error < 1e-12


ODD = [(1, [1.0, 2.0, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan")] * 3), (4, [1.0, 1.0, float("-inf")]),
       (5, []), (None, [0.5, 0.1, 9.0]), (1, [1.0, 2.0, 0.0]), (6, [1.0]), (7, [3e38, 1.0, 1.0]), (8, [2.0, 2.0, 5.0])]
SCHEMA = "vec_id long, embedding array<float>"


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3).selectExpr("*", "7 AS component", "8 AS n", "9 AS id", "1 AS v")
    rows = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in rows if r["component"] == 1) == ["1", "1", "8", "None"]
    assert {r["component"] for r in rows} == {1, 2}  # three different vectors span a plane
    assert all(r["n"] == 4 and r["identity_error"] < 1e-12 for r in rows)


@pytest.mark.parametrize("rows", [[], ODD[:1], [ODD[0], ODD[7]], [(1, None)]], ids=["empty", "one", "equal", "null"])
def test_no_variance_gives_no_row(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert df.count() == 0


def test_large_entries_stay_exact(spark):
    """Products beyond doubles, and deviations beyond a long."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 1e12).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    fit = whitening.fit_whitener(df)
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    assert fit.sums == [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    for i, v in enumerate(x):
        exact = sum((40 * c - s) ** 2 for c, s in zip(v, fit.sums))
        assert int(got[i]["deviation_exact"]) == exact
        assert got[i]["deviation"] == (exact if exact < 1 << 63 else None)
    assert got[0]["identity_error"] < 1e-10
