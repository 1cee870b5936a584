from pyspark.sql import functions as F

from themeflow.functions import text as TX


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_sentiment_bucket_ties_and_edges(spark):
    cases = {0.25: 0.0, -0.25: -0.5, 0.75: 0.5, 0.4: 0.5, -1.7: -1.0, 3.0: 1.0, 0.0: 0.0,
             float("nan"): -1.0, float("inf"): -1.0, float("-inf"): -1.0, 1e17: -1.0}
    for x, want in cases.items():
        assert one(spark, TX.sentiment_bucket, x, "double") == want, x


def test_clean_label_text(spark):
    assert one(spark, TX.clean_label_text, "Cluster 12\x00\x00") == "Cluster 12"
    assert one(spark, TX.clean_label_text, '"a b--') == "a b"
    assert one(spark, TX.clean_label_text, None) == ""
    assert one(spark, TX.clean_explanation_text, "`Ends with a stop.`") == "Ends with a stop."
    assert one(spark, TX.clean_label, "  \t ") == "Unclustered"
    assert one(spark, TX.clean_label, "x\x07y　 z") == "x y z"


def test_generic_label(spark):
    assert one(spark, TX.is_generic_label, "Cluster 12\x00") is True
    assert one(spark, TX.is_generic_label, "cluster_a-1") is True
    assert one(spark, TX.is_generic_label, "") is True
    assert one(spark, TX.is_generic_label, "earned romantic buildup") is False


def test_strip_fence(spark):
    assert one(spark, TX.strip_fence, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, TX.strip_fence, '  {"a": 1} ') == '{"a": 1}'
    assert one(spark, TX.strip_fence, "```json") is None
    assert one(spark, TX.strip_fence, '```\n{"a": 1}') == '{"a": 1}'


def test_percent_rounding_half_even(spark):
    assert one(spark, TX.percent_1dp, 6.25, "double") == 6.2
