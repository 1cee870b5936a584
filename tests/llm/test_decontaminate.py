import random

import pytest
from helpers import small_docs, sorted_rows

from themeflow.llm.decontaminate import (ItemScanner, MatchSettings, Myers, brute_force, contamination, pieces, plain,
                                         remove_contaminated)
from themeflow.llm.queries import QUERIES

import pyarrow as pa

ITEMS = ["The quick brown fox jumps over the lazy dog, and then it sleeps.", "How many roads must a man walk down?",
         "short", "", None, "  HOW many\nroads must a man   walk down? "]


def edited(text, k, rng):
    t = list(text)
    for _ in range(k):
        at, what = rng.randrange(len(t)), rng.randrange(3)
        if what == 0:
            t[at] = "@"
        elif what == 1:
            del t[at]
        else:
            t.insert(at, "#")
    return "".join(t)


def frames(spark, rows):
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string"))


def test_equals_dynamic_programming(spark):
    rng = random.Random(2)
    rows = [(i, "Some words before. " + edited(ITEMS[i % 2], i % 9, rng) + " and after " + ITEMS[0][:20])
            for i in range(60)] + [(70, ITEMS[1] * 3), (71, None), (72, "")]
    docs, items = frames(spark, rows)
    got = sorted_rows(contamination(docs, items))
    assert got == sorted(brute_force(rows, list(enumerate(ITEMS))), key=str)
    assert {r[2] for r in got} >= {0, 1, 2}
    kept = {r.doc_id for r in remove_contaminated(docs, items).collect()}
    assert kept == {d for d, _ in rows} - {r[0] for r in got}


def test_blocks_of_items_find_the_same(spark):
    rows = [(0, ITEMS[0]), (1, ITEMS[1] + ITEMS[0]), (2, "nothing")]
    docs, items = frames(spark, rows)
    few = MatchSettings(block_chars=40)
    assert sorted_rows(contamination(docs, items, few)) == sorted_rows(contamination(docs, items))
    assert [r.doc_id for r in remove_contaminated(docs, items, few).collect()] == [2]


@pytest.mark.parametrize("k", range(0, 7))
def test_pieces_cover_the_item(k):
    text = "abcdefghijklmnopqrstuvwxyz"
    parts = pieces(text, k)
    assert "".join(p for _, p in parts) == text and len(parts) == k + 1
    assert all(text[a:a + len(p)] == p for a, p in parts)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        row, best = list(range(len(p) + 1)), len(p)
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
            row, best = new, min(best, new[-1])
        assert Myers(p).least(t) == best


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    _, items = frames(spark, [(0, "")])
    assert sorted_rows(contamination(odd_docs, items)) == [(11, 2, 0)]       # the word "short"
    kept = remove_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted_rows(kept) == sorted_rows(odd_docs.filter("doc_id <> 11"))
    assert contamination(no_docs, items).count() == 0 and remove_contaminated(no_docs, items).count() == 0
    none = items.filter("false")
    assert contamination(odd_docs, none).columns == ["doc_id", "item_id", "edits"]
    twice = spark.createDataFrame([(1, ITEMS[0]), (1, ITEMS[0]), (None, ITEMS[0])], "doc_id long, text string")
    assert contamination(twice, items).count() == 3


def test_query(spark):
    got = sorted_rows(QUERIES["op6_decontaminate"](spark, "/root/testdata/sf0.001"))
    s, want = MatchSettings(), []
    docs = [(r.doc_id, plain(pa.array([r.text], pa.string()))[0]) for r in small_docs(spark, 10 ** 9).collect()]
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect():
        item = plain(pa.array([r.text]))[0]
        probe = Myers(item)
        near = [(d, probe.least(t)) for d, t in docs if any(p in t for p in {item[i:i + 9] for i in range(0, len(item) - 8, 9)})]
        want += [(d, r.item_id, e) for d, e in near if e <= s.budget(item)]
    assert got == sorted(want, key=str) and got


def test_scanner_gives_least_edits_of_several_places():
    item = plain(pa.array([ITEMS[0]]))[0]
    text = item.replace("fox", "cat") + " ... " * 30 + item.replace("f", "v")
    assert dict(ItemScanner([(5, item)], MatchSettings()).find(text)) == {5: 1}


def test_short_items_are_found_as_words(spark):
    items = [("a", "Paris"), ("b", "E = mc2"), ("c", ""), ("d", None), ("e", " 42 "), ("f", ITEMS[1])]
    rows = [(0, "we love PARIS"), (1, "comparison"), (2, "paris"), (3, "so e  =\nmc2, you see"), (4, "E = mc2 is"), (5, "142 421"),
            (6, "it is 42 now"), (7, "Parisian"), (8, None), (9, "pariss paris")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame(items, "item_id string, text string")
    got = sorted_rows(contamination(docs, names))
    assert got == sorted(brute_force(rows, items), key=str)
    assert {(d, i) for d, i, _ in got} == {(0, "a"), (2, "a"), (9, "a"), (4, "b"), (6, "e")}
    assert {r.doc_id for r in remove_contaminated(docs, names).collect()} == {1, 3, 5, 7, 8}
