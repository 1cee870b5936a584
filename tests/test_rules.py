"""Rules that the registered tables do not exercise."""

import pytest

from themeflow.operators import ingest as IN
from themeflow.operators import state as SM
from themeflow.operators.annotate import call_model, parse_item_responses
from themeflow.operators.themes import compact_themes
from themeflow.session import checkpoint_dir, materialize
from themeflow.sources import payloads as PL


def test_rows_without_theme_take_no_place(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)] * 9 + [("b",)] * 2 + [("c",)], "consolidated_tag string")
    got = {(r.consolidated_tag, r.theme_display) for r in compact_themes(df, top_n=2).collect()}
    assert got == {("a", "a"), ("b", "b"), ("c", "Other themes"), (None, "Other themes")}


def _posts(spark, rows):
    return spark.createDataFrame([(q, r, i, "t", "body", a) for q, r, i, a in rows],
                                 "query_id string, rank long, id string, title string, selftext string, author string")


def test_a_post_of_two_queries_counts_for_both(spark):
    cands = _posts(spark, [("q1", 1, "a", "u"), ("q1", 2, "b", "u"), ("q2", 1, "a", "u"), ("q2", 2, "c", "u")])
    kept = IN.ingest_posts(cands, None, post_limit=1, skip_existing=False)
    assert sorted((r.query_id, r.id) for r in kept.collect()) == [("q1", "a"), ("q2", "a")]


@pytest.mark.parametrize("k", [5, 1500])
def test_first_k_and_quota_for_any_k(spark, k):
    rows = [("hot", i, f"i{i:05}", "somebot" if i % 3 == 0 else "u") for i in range(4000)] + [("few", 1, "x", "u")]
    cands = _posts(spark, rows).repartition(6)
    order = IN.search_order()
    first = IN.first_k(cands, k, "query_id", order)
    assert sorted(r["rank"] for r in first.filter("query_id = 'hot'").collect()) == list(range(k))
    kept = IN.ingest_posts(cands, None, post_limit=k)
    hot = sorted(r["rank"] for r in kept.filter("query_id = 'hot'").collect())
    usable = [i for i in range(4000) if i % 3]
    assert hot == list(range(usable[k - 1] + 1)) and kept.filter("query_id = 'few'").count() == 1


def test_large_k_is_limited_before_the_group_meets(spark):
    plan = IN.first_k(_posts(spark, [("q", 1, "a", "u")]), 2000, "query_id", IN.search_order())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [row_number()") >= 2 and "__salt" in text


def test_pages_without_number_and_long_pages(spark):
    post = spark.createDataFrame([("q", 1, None, ["a", "b"]), ("q", 1, 2, ["c"])],
                                 "query_id string, source_priority int, page_no int, ids array<string>")
    from pyspark.sql import functions as F
    fields = [f.name for f in PL.S.POST_FIELDS.fields]
    pages = post.withColumn("posts", F.transform("ids", lambda i: F.struct(
        *[(i if c == "id" else F.lit(None).cast("string")).alias(c) for c in fields])))
    got = PL.post_candidates(pages).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == ["a", "b", "c"]
    kept = IN.quota(PL.post_candidates(pages).withColumn("status", F.lit("pending")), 2, IN.search_order())
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]


def test_null_order_values_are_kept_or_cut_as_sorted(spark):
    rows = spark.createDataFrame([("q", None, "a", "p"), ("q", None, "b", "p"), ("q", 5, "c", "p")],
                                 "query_id string, score long, id string, status string")
    kept = IN.quota(rows, 1, [("score", True), ("id", False)])
    assert [r.id for r in kept.collect()] == ["c"]
    kept = IN.quota(rows, 2, [("score", False), ("id", False)])
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]


def test_results_touch_their_own_item_type(spark):
    items = spark.createDataFrame([("x", "pending"), ("y", "pending")], "id string, status string")
    ann = spark.createDataFrame([], "item_id string, item_type string, sentiment double")
    res = spark.createDataFrame([("x", "post", 1.0, None), ("y", "comment", None, "bad"), ("y", "comment", 0.5, None)],
                                "item_id string, item_type string, sentiment double, error string")
    new_items, new_ann = SM.apply_annotation_results(items, ann, res, "comment")
    assert {r.id: r.status for r in new_items.collect()} == {"x": "pending", "y": "processed"}
    assert [tuple(r) for r in new_ann.collect()] == [("y", "comment", 0.5)]


def test_model_is_called_once_per_item(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return ['{"sentiment": 0, "summary": "s", "raw_tag": "t", "is_substantive": true}'] * len(texts)
    inputs = spark.range(40).selectExpr("cast(id as string) item_id", "'comment' item_type", "'text' text")
    results = materialize(parse_item_responses(call_model(inputs, model).drop("text")), "results")
    items = inputs.selectExpr("item_id id", "'pending' status")
    ann = spark.createDataFrame([], "item_id string, item_type string, sentiment double, summary string")
    new_items, new_ann = SM.apply_annotation_results(items, ann, results)
    assert new_items.filter("status = 'processed'").count() == 40 and new_ann.count() == 40
    assert calls.value == 40


def test_embedder_and_labeller_are_called_once_per_item(spark):
    from themeflow.operators.stage2 import cluster_themes
    from themeflow.schemas import ANNOTATIONS
    embedded, labelled = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def embed(texts):
        embedded.add(len(texts))
        return ["[1.0, 0.0]" if "Tag: a" in t else "[0.0, 1.0]" for t in texts]

    def label(texts):
        labelled.add(len(texts))
        return ['{"label": "One", "explanation": "x"}'] * len(texts)
    rows = [dict(item_id=str(i), item_type="comment", sentiment=0.0, summary="s", raw_tag="a" if i % 2 else "b",
                 is_substantive=True, reception_reason="r") for i in range(24)]
    ann = spark.createDataFrame([tuple(r.get(f.name) for f in ANNOTATIONS.fields) for r in rows], ANNOTATIONS)
    out = cluster_themes(ann, label, min_cluster_size=3, embedder=embed)
    assert out.count() == 24 and out.filter("cluster_id >= 0").count() == 24
    assert embedded.value == 24 and labelled.value == 2


def test_attempts_are_counted_until_none_is_left(spark):
    from themeflow.operators.annotate import count_attempts, retry_queue
    calls = spark.createDataFrame([("a", "429 rate limit"), ("b", None), ("c", "bad answer")], "item_id string, error string")
    done = count_attempts(calls)
    for left in (1, 1, 0):
        again = retry_queue(done)
        assert [r.item_id for r in again.collect()] == ["a"] * left
        done = count_attempts(calls.filter("item_id = 'a'"), done)


def test_payloads_through_another_reader(spark):
    asked = []

    def reader(session, schema, path):
        asked.append(path)
        line = '{"query_id": "q", "source_priority": 1, "page_no": 1, "data": {"children": [{"data": {"id": "a"}}]}}'
        return session.read.schema(schema).json(session.sparkContext.parallelize([line]))
    got = PL.read_post_candidates(spark, "store://key", reader=reader)
    assert [r.id for r in got.collect()] == ["a"] and asked == ["store://key"]


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        checkpoint_dir(Session())
