import numpy as np
from helpers import sorted_rows

from themeflow.llm.cuckoo import CuckooFilter
from themeflow.llm.line_index import LineIndex, brute_force, dedup_lines, digest, halves

LONG = "a line of some length"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    f = CuckooFilter.sized_for(len(keys))
    f.insert(keys)
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    others = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.01
    f.remove(keys[:25_000])
    assert f.contains(keys[25_000:]).all() and f.contains(keys[:25_000]).mean() < 0.01
    CuckooFilter.sized_for(0).insert(np.empty(0, np.uint64))


def test_equal_hashes_overflow_into_an_error_not_a_loop():
    f = CuckooFilter.sized_for(2)
    f.insert(np.array([7, 7], np.uint64))
    assert f.contains(np.array([7], np.uint64)).all()


def test_documents_equal_brute_force(spark, odd_docs):
    rows = [(i, "\n".join([LONG.upper() if i % 2 else f" {LONG}\t", "short", f"own line number {i}", LONG]))
            for i in range(30)] + [(40, None), (41, ""), (42, "\n\n"), (43, "0123456789"), (44, "0123456789 "),
                                   (45, "012345678"), (46, "012345678")]
    assert sorted_rows(digest(dedup_lines(docs(spark, rows)))) == sorted(brute_force(rows), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted_rows(digest(dedup_lines(df))) == sorted(brute_force(rows), key=str)


def test_deletion_undoes_insertion(spark):
    rows = [(i, f"{LONG}\nline of document {i % 7}\n{LONG} {i}") for i in range(24)]
    index = LineIndex(spark)
    for batch in halves(docs(spark, rows)):
        index.insert(batch)
    gone = [r for r in rows if r[0] < 9 or r[0] == 20]
    left = [r for r in rows if r not in gone]
    index.delete(docs(spark, gone))
    assert sorted_rows(digest(index.cleaned(docs(spark, left)))) == sorted(brute_force(left), key=str)
    index.insert(docs(spark, gone))
    assert sorted_rows(digest(index.cleaned(docs(spark, rows)))) == sorted(brute_force(rows), key=str)


def test_filters_follow_the_counts(spark):
    index = LineIndex(spark, n_shards=2)
    index.insert(docs(spark, [(1, LONG), (2, LONG + " b")]))
    index.delete(docs(spark, [(1, ""), (2, "")]))
    assert index.counts().count() == 0
    assert all(not any(bytes(r.blob)) for r in index.filters().collect())


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    out = dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns + ["__lines"] and out.count() == odd_docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text is None and by[0]["__lines"].n_lines == 1 and by[11].text == by[11].text
    # both rows of id 50 are one document, and its line is too short for a key
    assert [r.text for r in out.filter("doc_id = 50").collect()] == ["a b c d"] * 2
    assert by[51].text == "" and by[51]["__lines"].n_dropped == 1          # repeats the line of document 9
    assert dedup_lines(no_docs).count() == 0
    nulls = docs(spark, [(None, LONG), (1, LONG), (None, LONG)])
    assert sorted_rows(dedup_lines(nulls).select("doc_id", "text")) == sorted(
        [(None, LONG), (None, LONG), (1, "")], key=str)
