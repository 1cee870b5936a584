"""Posting table for text search: same rows as the scan, fewer files."""
import pytest

from themeflow.operators.filters import search_expression
from themeflow.operators.text_index import TextIndex, grams

SCHEMA = "id string, title string, selftext string"
WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord"]


def posts(lo, hi):
    out = []
    for i in range(lo, hi):
        a, b = WORDS[i % 6], WORDS[i // 6 % 6]
        out.append((f"p{i:03d}", None if i % 11 == 0 else f"{a} no{i}", None if i % 7 == 0 else f"{b.upper()} of {a}\nline"))
    return out


EXTRA = [("x1", "", ""), ("x2", None, None), ("x3", "Zürich ÉTÉ", "naïve 😀😀😀 faces"), ("x4", "the", "needle in hay"),
         ("x5", "a.b*c", "50% off"), ("x6", "ab", "c"), ("x7", "long " * 5000, "tail needle")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("an index")), rows_per_file=10)
    out.add(spark.createDataFrame(posts(0, 120), SCHEMA).coalesce(1), name="one")
    out.add(spark.createDataFrame(posts(120, 200) + EXTRA, SCHEMA).coalesce(1), name="two")
    out.add(spark.createDataFrame(posts(0, 120), SCHEMA), name="one")     # a repeated batch
    return out


@pytest.fixture(scope="module")
def everything(spark):
    return spark.createDataFrame(posts(0, 200) + EXTRA, SCHEMA)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("expression", [
    "amber", "AMBER AND birch", "amber OR fjord", "amber NOT birch", "NOT amber", "{amber AND cedar} OR (needle NOT tail)",
    '"of amber"', "no17", "no", "am", "amber ab", "été", "ZÜRICH", "😀😀😀", '"b c"', "a.b*c", "50%", "zzzz", "", "needle OR x"])
def test_equals_the_scan(index, everything, expression):
    assert ids(index.search(expression)) == ids(search_expression(everything, expression))


def test_rare_terms_open_few_files(index, everything):
    total = len(index.search("no").inputFiles())
    assert total >= 20
    assert len(index.search("needle").inputFiles()) <= 2
    assert len(index.search("no17 AND delta").inputFiles()) <= 2
    assert len(index.search('no150 OR "naïve"').inputFiles()) <= 2
    assert index.search("zzzz").count() == 0
    found = index.candidates("needle AND hay").collect()
    assert len(found) == 1


def test_terms(spark, tmp_path):
    assert grams("Amber") == ["amb", "ber", "mbe"] and grams("ab") == [] and grams("aaaa") == ["aaa"]
    with pytest.raises(FileNotFoundError, match="no batch"):
        TextIndex(spark, str(tmp_path)).search("amber")
    empty = TextIndex(spark, str(tmp_path))
    empty.add(spark.createDataFrame([], SCHEMA))
    assert empty.search("amber").count() == 0 and empty.search("").count() == 0
