import numpy as np
import pytest

from themeflow.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of all pairs of rows."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)
    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [[] for _ in rows]
    for i, u in enumerate(units):
        for j, w in enumerate(units[:i]):
            if u is not None and w is not None and len(u) == len(w) and rows[i][2] == rows[j][2] and u @ w >= cosine:
                links[i].append(j)
                links[j].append(i)
    out, seen = [None] * len(rows), set()
    for start in range(len(rows)):
        if start in seen:
            continue
        stack, part = [start], []
        seen.add(start)
        while stack:
            part.append(stack.pop())
            more = [k for k in links[part[-1]] if k not in seen]
            seen.update(more)
            stack += more
        ids = [rows[k][0] for k in part if rows[k][0] is not None]
        for k in part:
            out[k] = (rows[k][0], len(links[k]), min(ids, default=None), rows[k][0] == min(ids, default=None))
    return sorted(out, key=str)


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS rep", "2 AS rid", "3 AS n_links", "4 AS id")
    return sorted(map(tuple, cp.near_duplicates(df, cp.NearSettings(**settings)).collect()), key=str)


def around(rng, centre, noise, many):
    v = centre + rng.normal(size=(many, len(centre))) * noise * np.linalg.norm(centre) / np.sqrt(len(centre))
    return v.tolist()


def clustered(seed=0, dims=64):
    """Groups from two to dozens, tight, loose and chained, among strangers."""
    rng = np.random.default_rng(seed)
    rows = []
    for group, (many, noise) in enumerate([(2, .1), (3, .25), (60, .05), (60, .2), (25, .3), (40, .001)]):
        for v in around(rng, rng.normal(size=dims), noise, many):
            rows.append((v, group % 2))
    rows += [(rows[70][0], 1)] * 30 + [((2 * np.array(rows[70][0])).tolist(), 1), (rows[70][0], 0), (rows[70][0], None)]
    rows += [(rng.normal(size=dims).tolist(), k % 2) for k in range(150)]
    order = rng.permutation(len(rows))
    return [(int(order[i]) * 3, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"run_limit": 16}, {"run_limit": 8, "seed": 2}], ids=str)
def test_equals_brute_force(spark, settings):
    """No pair of this fixture is missed, with and without pieces and balls."""
    assert found(spark, clustered(), **settings) == brute(clustered())


@pytest.mark.parametrize("width", [1, 2, 3])
def test_recall_at_the_bound(width):
    """Random pairs at a cosine of exactly 0.93."""
    rng = np.random.default_rng(width)
    probes, tables = cp._PLANS[width]
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    y = .93 * x + np.sqrt(1 - .93 ** 2) * g / np.linalg.norm(g, axis=1)[:, None]
    a, b = (cp.bucket_codes(v, width, probes, tables, 13) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert met >= .99
    strangers = (a[:, :, :, None] == np.roll(a, 1, axis=0)[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert strangers <= 2 * tables * probes ** 2 / 128 ** width + 0.002


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 1e-3], 1), (3, [1.0, 0.0], None), (4, None, 1),
            (5, [0.0, -0.0], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
            (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [1.0], 1), (12, [5.0], 1), (2, [1.0, 0.0], 1),
            (2, [0.0, 1.0], 1), (13, [1e300, 1e300], 2), (14, [1e-300, 1e-300], 2), (None, [3.0, -3.0], 7),
            (15, [1.0, 0.0, 0.0], 1), (16, [-1.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = cp.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and df.count() == 0


def test_error_of_sketches_is_bounded():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, lost = cp.sketch(x)
    near = (q.astype(float) @ q.T) * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= lost[:, None] + lost + 2 * lost[:, None] * lost).all()


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cp.hadamard(cp.hadamard(x)), x)
