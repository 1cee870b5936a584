import json
import os

from pyspark.sql import functions as F

from themeflow.operators import ingest as IN
from themeflow.sources import payloads as PL


def write_lines(path, objs):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.json"), "w") as f:
        for o in objs:
            f.write(json.dumps(o) + "\n")


def post(i, author="RealUser", text="hello", **kw):
    return {"id": i, "title": f"t{i}", "selftext": text, "author": author, "subreddit": "s", "score": 1,
            "created_utc": 1.0, **kw}


def test_low_quality_cases(spark):
    rows = [("AutoModerator", "x"), ("u", "[deleted]"), ("u", "[removed]"), ("RealUser", "text"),
            ("Abbott", "text"), ("u", " [deleted] "), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(IN.is_low_quality("a", "b")).collect()]
    assert got == [True, True, True, False, True, False, True]


def test_search_fallback_and_quota(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "search")
    write_lines(d, [
        {"query_id": "q", "source_priority": 1, "page_no": 0, "data": {"children": []}},
        {"query_id": "q", "source_priority": 3, "page_no": 0,
         "data": {"children": [{"kind": "t3", "data": post("a", author="AutoModerator")}]}},
        {"query_id": "q", "source_priority": 3, "page_no": 1,
         "data": {"children": [{"kind": "t3", "data": post("b")}, {"kind": "t3", "data": post("c")},
                               {"kind": "t3", "data": post("a")}]}},
    ])
    cands = PL.read_post_candidates(spark, search_path=d)
    kept = IN.ingest_posts(cands, None, post_limit=1)
    got = sorted((r.id, r.status) for r in kept.collect())
    assert got == [("a", "skipped"), ("b", "pending")]


def test_missing_fields_default(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "archive")
    write_lines(d, [{"query_id": "q", "source_priority": 1, "page_no": 0, "data": [{"id": "only"}]}])
    kept = IN.ingest_posts(PL.read_post_candidates(spark, archive_path=d), None).first()
    assert (kept.title, kept.selftext, kept.score, kept.created_utc, kept.status) == ("", "", 0, 0.0, "skipped")


def test_comment_kind_filter_cap_and_source(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "comments")
    kids = [{"kind": "t1", "data": {"id": "c1", "body": "x", "author": "u"}},
            {"kind": "more", "data": {"id": "m"}},
            {"kind": "t1", "data": {"id": "c2", "body": "[removed]", "author": "u"}},
            {"kind": "t1", "data": {"id": "c3", "body": "y", "author": "u"}}]
    write_lines(d, [
        {"post_id": "p1", "source_priority": 1, "payload": json.dumps({"not": "a list"})},
        {"post_id": "p1", "source_priority": 2, "payload": json.dumps([{}, {"data": {"children": kids}}])},
        {"post_id": "p2", "source_priority": 1, "payload": json.dumps([{}, {"data": {"children": []}}])},
        {"post_id": "p2", "source_priority": 2, "payload": json.dumps([{}, {"data": {"children": kids}}])},
    ])
    cands, invalid = PL.read_comment_candidates(spark, comment_path=d, comment_limit=2)
    posts = spark.createDataFrame([("p1",), ("p2",)], "id string")
    got = sorted((r.id, r.status) for r in IN.ingest_comments(cands, posts, 2).collect())
    assert got == [("c1", "pending"), ("c2", "skipped")]
    assert invalid.count() == 1


def test_skip_existing_drops_posts_and_their_comments(spark):
    cands = spark.createDataFrame([("q", 0, "a", "t", "x", "u"), ("q", 1, "b", "t", "y", "u")],
                                  "query_id string, rank long, id string, title string, selftext string, author string")
    stored = spark.createDataFrame([("a",)], "id string")
    kept = IN.ingest_posts(cands, stored, post_limit=5)
    assert [r.id for r in kept.collect()] == ["b"]
    comments = spark.createDataFrame([("a", 0, "ca", "x", "u"), ("b", 0, "cb", "y", "u")],
                                     "post_id string, pos long, id string, body string, author string")
    assert [r.id for r in IN.ingest_comments(comments, kept).collect()] == ["cb"]
