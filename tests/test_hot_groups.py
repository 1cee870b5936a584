"""Groups that hold most of the rows are dealt over many tasks."""
import numpy as np
from pyspark.sql import functions as F

from themeflow.operators import clustering as CL
from themeflow.operators import ingest as IN
from themeflow.functions.vectors import with_unit_vectors


def vectors(spark, n=400, dims=5):
    rng = np.random.default_rng(4)
    rows = [(f"i{k:04d}", rng.normal(size=dims).tolist(), 0 if k % 3 else k % 9) for k in range(n)]
    return with_unit_vectors(spark.createDataFrame(rows, "item_id string, embedding array<double>, cluster_id int"))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_centroid_in_blocks(spark):
    """Any number of blocks gives what one matrix gives, ties to the lowest id."""
    m = vectors(spark)
    cents = CL.centroids(m)
    twice = cents.unionByName(cents.withColumn("cluster_id", F.col("cluster_id") + 100))
    x = {r.item_id: np.array(r.unit) for r in m.collect()}
    c = {r.cluster_id: np.array(r.centroid) for r in cents.collect()}
    for block in (1, 2, 2048):
        got = CL.nearest_centroid(m, twice, block=block).collect()
        assert len(got) == len(x)
        for r in got:
            sims = {k: float(x[r.item_id] @ v) for k, v in c.items()}
            assert r.assigned == max(sims, key=sims.get)
            assert abs(r.similarity - max(sims.values())) < 1e-12


def test_more_centroids_than_one_matrix_may_hold(spark):
    """20,000 centroids in blocks; nothing of them is collected."""
    rng = np.random.default_rng(5)
    cents = spark.range(20_000).select(F.col("id").cast("int").alias("cluster_id"), F.array(
        F.cos("id"), F.sin("id")).alias("centroid"))
    points = spark.createDataFrame([(str(k), [float(np.cos(k)), float(np.sin(k))]) for k in range(50)],
                                   "item_id string, unit array<double>")
    got = CL.nearest_centroid(points, cents)
    assert "Cartesian" not in plan(got) and "BroadcastNestedLoop" not in plan(got)
    assert {r.item_id: r.assigned for r in got.collect()} == {str(k): k for k in range(50)}


def test_no_centroid(spark):
    m = vectors(spark, 5)
    got = CL.nearest_centroid(m, CL.centroids(m.filter("cluster_id > 99"))).collect()
    assert [(r.assigned, r.similarity) for r in got] == [(-1, None)] * 5


def test_representatives_of_a_hot_cluster(spark):
    """Equal to sorting the whole cluster, for any k; the join and the first
    window are by cluster and part."""
    m = vectors(spark)
    cents = CL.centroids(m)
    c = {r.cluster_id: np.array(r.centroid) for r in cents.collect()}
    for k in (1, 15, 2000):
        got = {(r.cluster_id, r.rep_rank): r.item_id for r in CL.representatives(m, cents, k).collect()}
        want = {}
        for cluster in c:
            of = sorted((1 - float(np.array(r.unit) @ c[cluster]), r.item_id) for r in m.filter(F.col("cluster_id") == cluster).collect())
            want |= {(cluster, i + 1): name for i, (_, name) in enumerate(of[:k])}
        assert got == want
    assert "__salt" in plan(CL.representatives(m, cents, 15))


def test_quota_of_a_hot_query(spark):
    """One query holds nine tenths of the posts; its cut-off meets them in parts."""
    rows = [("hot" if k % 10 else f"q{k % 30}", f"p{k:04d}", k, "skipped" if k % 7 == 0 else "pending") for k in range(900)]
    posts = spark.createDataFrame(rows, "query_id string, id string, rank long, status string")
    order = IN.search_order()
    for limit in (3, 40, 5000):
        got = {r.id for r in IN.quota(posts, limit, order).collect()}
        want, usable, = set(), {}
        for q, i, _, status in sorted(rows, key=lambda r: (r[2], r[1])):
            if usable.get(q, 0) < limit:
                want.add(i)
                usable[q] = usable.get(q, 0) + (status != "skipped")
        assert got == want
    out = IN.quota(posts, 3, order)
    assert "__salt" in plan(out) and out.columns == posts.columns


def test_map_of_fewer_than_two_items_is_empty(spark):
    rows = [("a", [1.0, 2.0], True, "theme")]
    df = spark.createDataFrame(rows, "item_id string, embedding array<double>, is_substantive boolean, consolidated_tag string")
    for part in (df, df.limit(0)):
        out = CL.semantic_map(part)
        assert out.count() == 0 and {"item_id", "theme", "x", "y", "theme_display"} <= set(out.columns)
