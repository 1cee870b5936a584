import re

import pytest

from themeflow.operators import browse as BR
from themeflow.operators import filters as FL
from themeflow.operators import stats as ST
from themeflow.operators import themes as TH
from themeflow.session import materialize
from themeflow.sources import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("expression,want", [
    ("", "ABCD"), ("red", "AB"), ("RED", "AB"), ("red AND blue", "B"), ("red blue", "B"), ("red OR green", "ABC"),
    ("NOT red", "CD"), ("red NOT blue", "A"), ("{red AND blue} OR (green)", "BC"), ('"light green"', "C"),
    ("red OR green AND blue", "AB"), ("(red OR green) AND NOT {blue}", "AC"), ("NOT (red OR green)", "D"), ("and", "")])
def test_search_expressions(spark, expression, want):
    df = spark.createDataFrame([("A", "red"), ("B", "red blue"), ("C", "a light green"), ("D", None)], "id string, title string")
    got = FL.search_expression(df, expression, fields=("title",)).collect()
    assert "".join(sorted(r.id for r in got)) == want


@pytest.mark.parametrize("bad", ["(red", "red)", "red AND", "OR red", "NOT", "()"])
def test_search_errors(bad):
    with pytest.raises(ValueError):
        FL.parse_search(bad)


def scans(df):
    """Scans of the stored table in the plan that ran (reused shuffles are one)."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"(?:FileScan|Scan) parquet", text))


@pytest.fixture(scope="module")
def stored(spark):
    return materialize(B.thread_annotations(spark, SF), "annotations")


@pytest.mark.parametrize("report", [
    lambda a: TH.pareto(a, 10), lambda a: TH.dominance_chart(a, 10), TH.sentiment_by_theme, ST.sentiment_distribution])
def test_reports_scan_the_items_once(stored, report):
    assert scans(report(stored)) == 1


def test_top_n_reports_start_no_job(spark, stored):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "reports are lazy")
    TH.pareto(stored, 10)
    TH.dominance_chart(stored, 10)
    TH.sentiment_by_theme(stored)
    assert list(tracker.getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setJobGroup("", "")


def test_pareto_of_nothing(spark, stored):
    assert TH.pareto(stored.filter("false"), 5).count() == 0 and TH.pareto(stored.filter("false"), None).count() == 0
    with pytest.raises(ValueError):
        TH.pareto(stored, -1)


def test_slices_equal_the_whole_listing(spark, monkeypatch):
    items, ann = B.thread_comments(spark, SF), B.thread_annotations(spark, SF)
    whole = {r.row_index: tuple(r) for r in BR.listing(items, ann, "comment").collect()}
    for top in (10_000, 3):
        monkeypatch.setattr(BR, "TOP_ROWS", top)
        got = BR.listing_selection(items, ann, "comment", "7 12-15 9")
        assert {r.row_index: tuple(r) for r in got.collect()} == {k: whole[k] for k in (7, 9, 12, 13, 14, 15)}
    last, pages = BR.listing_page(items, ann, "comment", 10 ** 9, 7)
    assert {r.row_index for r in last.collect()} == {k for k in whole if k > (pages - 1) * 7}
    assert BR.listing_selection(items, ann, "comment", "x").count() == 0
