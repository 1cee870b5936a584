"""Stored listings: equal to the listing that orders all ids, few files read."""
import os

import pytest
from pyspark.sql import functions as F

from themeflow.operators import browse as BR
from themeflow.operators.stored_listing import StoredListing

ITEMS = "id string, status string, created_utc double, body string"
NOTES = "item_id string, consolidated_tag string, raw_tag string"
STATES = ["pending", "processed", "removed"]


def rows(n):
    items = [(f"c{i:04d}", STATES[i % 3], None if i % 50 == 7 else float(i * 37 % 101), f"text {i}\nmore") for i in range(n)]
    notes = [(f"c{i:04d}", ["blue", "red", None][i % 3 if i % 2 else 2], f"raw{i}") for i in range(0, n, 1) if i % 5]
    return items, notes


@pytest.fixture(scope="module")
def frames(spark):
    items, notes = rows(400)
    return spark.createDataFrame(items, ITEMS).repartition(5), spark.createDataFrame(notes, NOTES)


@pytest.fixture(scope="module")
def stored(spark, frames, tmp_path_factory):
    out = StoredListing(spark, str(tmp_path_factory.mktemp("a listing")))
    out.store(*frames, "comment", rows_per_file=20, partitions=6)
    return out


@pytest.mark.parametrize("status,theme", [("All", "All"), ("Processed", "All"), ("All", "blue"), ("Pending", "None"),
                                          ("All", "no such theme")])
def test_equals_the_listing(frames, stored, status, theme):
    want = sorted(map(tuple, BR.listing(*frames, "comment", status, theme).collect()), key=lambda r: r[-1])
    assert stored.count(status, theme) == len(want)
    got = stored.ranges([(1, 10_000)], status, theme)
    assert got.columns == BR.listing(*frames, "comment", status, theme).columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == want
    page, pages = stored.page(2, 7, status, theme)
    assert pages == max(1, -(-len(want) // 7))
    assert sorted(map(tuple, page.collect()), key=lambda r: r[-1]) == want[7:14]


def test_a_page_opens_the_files_that_hold_it(frames, stored):
    all_files = {r.file for r in stored.files.read().select("file").distinct().collect()}
    assert len(all_files) >= 20
    for page_no in (1, 17, 40):
        page, pages = stored.page(page_no, 10)
        assert pages == 40 and page.count() == 10 and len(page.inputFiles()) <= 2
    one = stored.selection("200")
    assert len(one.inputFiles()) == 1 and [r.row_index for r in one.collect()] == [200]
    last, _ = stored.page(10 ** 9, 10)
    assert {r.row_index for r in last.collect()} == set(range(391, 401))


def test_versions_and_empty(spark, frames, tmp_path):
    items, notes = frames
    table = StoredListing(spark, os.path.join(str(tmp_path), "l"))
    table.store(items.limit(0), notes, "comment")
    assert table.count() == 0
    page, pages = table.page(3)
    assert pages == 1 and page.count() == 0 and "row_index" in page.columns
    table.store(items.filter(F.col("id") < "c0010"), notes, "comment")
    assert table.count() == 10 and table.selection("9-12").count() == 2
    table.store(items.filter(F.col("id") < "c0005"), notes.limit(0), "comment")
    assert table.count() == 5 and table.count(theme="None") == 5 and table.files.versions() == [0, 1, 2]
