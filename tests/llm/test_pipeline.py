import pyarrow as pa
from helpers import sorted_rows
from test_repetition import naive_report

import corpus_pipeline as P
from themeflow.llm import jaccard_join, line_index
from themeflow.llm.decontaminate import MatchSettings, Myers, plain
from themeflow.llm.line_index import line_keys
from themeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def clean_lines(rows):
    first = {}
    keyed = []
    for doc, text in rows:
        lines, keys, _ = line_keys(pa.array([text], pa.string()), 10)
        keyed.append((doc, lines.to_pylist(), keys.to_pylist()))
        for k in keys.to_pylist():
            if k is not None:
                first[k] = min(doc, first.get(k, doc))
    return [(doc, "\n".join(x for x, k in zip(lines, keys) if k is None or first[k] == doc)) for doc, lines, keys in keyed]


def test_run_equals_the_stages_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, SF).filter("kept").collect()}
    for doc, text in rows:
        if len(text or "") < 1200:
            assert naive_report(text)[6] == (doc in kept)
    rows = clean_lines([r for r in rows if r[0] in kept])
    groups = {d: c for d, _, c in jaccard_join.brute_force(rows, 5, 80)}
    rows = [r for r in rows if groups[r[0]] == r[0]]
    s = MatchSettings()
    items = [plain(pa.array([r.text]))[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    probes = [(Myers(i), s.budget(i), {i[k:k + 9] for k in range(0, len(i) - 8, 9)}) for i in items]
    texts = {d: plain(pa.array([t], pa.string()))[0] for d, t in rows}
    rows = [r for r in rows if not any(any(x in texts[r[0]] for x in parts) and m.least(texts[r[0]]) <= e
                                       for m, e, parts in probes)]
    got = {r.doc_id: r["size"] for r in P.run(spark, SF).collect()}
    assert got == {d: len([w for w in plain(pa.array([t], pa.string()))[0].split(" ") if w])
                   for d, t in rows}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
    for r in P.line_dedup(spark, docs, SF).collect():
        assert r.n_chars == len(r.text)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in P.STAGES:
        stage(spark, odd_docs, SF).collect()
        assert stage(spark, no_docs, SF).count() == 0, name


def test_line_digest_of_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted_rows(P.line_dedup(spark, docs, SF).select("doc_id", "text")) == sorted(clean_lines(rows), key=str)
    assert line_index.brute_force([(1, "a\nb")])[0][1:3] == (2, 0)


def test_the_stage_joins_at_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    near = list(words)
    near[30], near[60] = "x", "y"
    rows = [(1, " ".join(words)), (2, " ".join(near))]
    # five words: 86 / 106; four: 89 / 105
    assert [c for *_, c in jaccard_join.brute_force(rows)] == [1, 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in P.ngram_jaccard(spark, docs, SF).collect()] == [1]
