import json

from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators.stage2 import cluster_themes


def labeller(texts):
    return [json.dumps({"consolidated_tag": "Cluster 7", "explanation": ""}) for _ in texts]


def ann_rows(spark, rows):
    return spark.createDataFrame(
        [(i, "comment", 0.5, s, t, sub, r, None, None, None, e) for i, s, t, sub, r, e in rows], S.ANNOTATIONS)


def test_single_item_gets_cluster_zero_with_fallback(spark):
    ann = ann_rows(spark, [("a", "Great payoff.", "earned romantic buildup", True, None, [0.1, 0.2]),
                           ("b", "meh", "Reaction Only", False, None, [0.3, 0.1])])
    out = {r.item_id: r for r in cluster_themes(ann, labeller).collect()}
    assert (out["a"].cluster_id, out["a"].consolidated_tag) == (0, "earned romantic buildup")
    assert out["a"].cluster_explanation.endswith("share this pattern: Great payoff")
    assert (out["b"].cluster_id, out["b"].consolidated_tag) == (None, None)


def test_generic_labels_fall_back_and_identical_pair_has_no_cluster(spark):
    ann = ann_rows(spark, [("a", "s1", "t", True, "Affection", [0.1] * 8),
                           ("b", "s2", "t", True, "Affection", [0.1] * 8)])
    out = {r.item_id: r for r in cluster_themes(ann, labeller, min_cluster_size=2).collect()}
    # two identical points: the root is never a cluster -> no cluster, own strongest reason
    assert out["a"].consolidated_tag == "Affection"
    assert out["a"].cluster_explanation.startswith("HDBSCAN found no stable clusters")


def test_partition_count_does_not_change_reports(spark):
    from themeflow.operators.themes import pareto
    from themeflow.sources.bindings import thread_annotations
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in pareto(thread_annotations(spark, sf), top_n=0).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(tuple(r) for r in pareto(thread_annotations(spark, sf).repartition(5), top_n=0).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_reports_accept_the_legacy_layout(spark):
    import pytest
    from themeflow.operators.themes import pareto
    legacy = spark.createDataFrame([("a", "post", "Reaction Only", "x"), ("b", "comment", "t", "x"),
                                    ("c", "comment", "t", " unclustered ")],
                                   "item_id string, item_type string, raw_tag string, consolidated_tag string")
    rows = pareto(legacy, top_n=0).collect()
    assert [(r.theme, r.items_in_theme, r.comment_items) for r in rows] == [("x", 1, 1)]
    with pytest.raises(ValueError):
        pareto(legacy.drop("raw_tag"))
