from pyspark.sql import functions as F

from themeflow.llm.host_reputation import ReputationSettings, domain_of, host_of, judge_urls, path_of, suffix_of


def judged(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    marks = spark.createDataFrame(list(outcomes), "page_id long, bad int")
    return {r.page_id: r for r in judge_urls(pages, marks, ReputationSettings(**kw)).collect()}


def test_parts_of_urls(spark):
    urls = ["http://A.Example.com/x/y?q#f", "no scheme", None, "ftp://h?q=://z/", "http://É.COM#a/b", "http://h"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(host_of(F.col("url")), path_of(F.col("url"))).collect()]
    assert got == [("a.example.com", "/x/y"), ("", ""), ("", ""), ("h", ""), ("É.com", ""), ("h", "")]


def test_suffix_and_domain(spark):
    hosts = ["a.b.example.com", "x.shop.co.uk", "co.uk", "localhost", "", "example.org"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(suffix_of(F.col("h")), domain_of(F.col("h"), suffix_of(F.col("h")))).collect()]
    assert got == [("com", "example.com"), ("co.uk", "shop.co.uk"), ("uk", "co.uk"), ("localhost", "localhost"),
                   ("", ""), ("org", "example.org")]


def test_longest_rule_wins_and_subdomains_fit(spark):
    got = judged(spark, ["http://a.example.net/en/1", "http://x.net/1", "http://notexample.net/en/1",
                         "http://example.com/de/", "http://example.com/fr/", "http://a.org/fr/", "http://net", "net/"])
    assert [got[i].rule for i in range(8)] == [
        "example.net/en/", "net/", "net/", "example.com/de/", None, "org/fr/", None, None]
    assert [got[i].verdict for i in range(8)] == [
        "allow", "block", "block", "block", "allow", "allow", "allow", "allow"]


def test_bad_host_is_blocked_and_few_labels_are_shrunk(spark):
    urls = [f"http://good{i % 5}.fine.io/{i}" for i in range(200)] + [f"http://bad.evil.io/{i}" for i in range(60)]
    urls += ["http://new.evil.io/1", "http://once.fine.io/1"]
    marks = [(i, 0) for i in range(200)] + [(200 + i, 1) for i in range(60)] + [(261, 1)]
    got = judged(spark, urls, marks)
    assert got[230].verdict == "block" and got[260].verdict == "block"       # evil.io's other host
    assert got[0].verdict == "allow" and got[261].verdict == "allow"         # one bad label of a good domain


def test_odd_rows(spark):
    got = judged(spark, [None, "", "http:///p", "http://h/a"], [(None, 1), (3, None), (3, 1), (3, 1)])
    assert len(got) == 4 and got[3].n_labelled == 2 and got[0].host == ""
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty, spark.createDataFrame([], "page_id long, bad int")).count() == 0
