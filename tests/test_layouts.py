"""Broken payload lines, merged layouts, workspaces."""
import os

import pytest
from pyspark.sql import functions as F

from themeflow.operators import state as SM
from themeflow.sources import payloads as PL
from themeflow.sources import tables as TB
from themeflow.streaming import streams as ST


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


GOOD = '{"query_id":"q","source_priority":1,"page_no":0,"data":{"children":[{"kind":"t3","data":{"id":"a"}}]}}'
LINES = [GOOD, GOOD[:60], "[]", '"text"', "", "   ", GOOD.replace('"page_no":0', '"page_no":"x"'), GOOD.replace("query_id", "q"),
         GOOD.replace('"q"', '""'), GOOD.replace('"q"', "null")]
WANT = {GOOD[:60]: "not JSON", "[]": "not an object", '"text"': "not an object", LINES[6]: "field of a wrong type",
        LINES[7]: "no query_id", LINES[8]: "no query_id", LINES[9]: "no query_id"}


def test_no_broken_line_vanishes(spark, tmpdir_path):
    put(tmpdir_path, "one.json", LINES[:5])
    put(tmpdir_path, "two.json", LINES[5:])
    got = PL.rejected_payloads(spark, "search", tmpdir_path).collect()
    assert {r.record: r.reason for r in got} == WANT and len(got) == len(WANT)
    assert {os.path.basename(r.file) for r in got if r.record == "[]"} == {"one.json"}
    # what is right in the others is still read
    assert "a" in {r.id for r in PL.read_post_candidates(spark, search_path=tmpdir_path).collect()}


@pytest.mark.parametrize("kind", ["archive", "comments", "archive_comments"])
def test_other_kinds(spark, tmpdir_path, kind):
    owner = PL.PAYLOAD_KINDS[kind][1]
    put(tmpdir_path, "x.json", ['{"%s":"q","source_priority":1}' % owner, '{"%s":"q","source_priority":"one"}' % owner, "{", "{}"])
    got = {r.reason for r in PL.rejected_payloads(spark, kind, tmpdir_path).collect()}
    assert got == {"field of a wrong type", "not JSON", f"no {owner}"}


def test_rejects_of_a_stream_are_stored(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    table = TB.VersionedTable(spark, os.path.join(tmpdir_path, "rejects"))

    def run():
        rejects = PL.rejected_stream(spark, "search", src)
        ST.run_available_now(rejects, os.path.join(tmpdir_path, "ckpt"),
                             ST.upsert_batches(table, ["file", "record"], rejects.schema), output_mode="append")
    put(src, "one.json", LINES[:5])
    run()
    put(src, "two.json", LINES[5:])
    run()
    assert {r.record: r.reason for r in table.read().collect()} == WANT


def test_layouts_are_merged(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "annotation")
    spark.createDataFrame([("a", "Reaction Only"), ("b", "tag"), ("c", None)], "item_id string, raw_tag string").write.parquet(path)
    spark.createDataFrame([("d", "t", False, "r", "e"), ("e", "t", True, None, None)],
                          "item_id string, raw_tag string, is_substantive boolean, reception_reason string, "
                          "cluster_explanation string").write.mode("append").parquet(path)
    got = {r.item_id: r for r in SM.backfill_annotations(TB.open_table(spark, tmpdir_path, "annotation")).collect()}
    assert {k: (r.is_substantive, r.reception_reason, r.cluster_explanation) for k, r in got.items()} == {
        "a": (False, None, None), "b": (True, "tag", None), "c": (True, None, None), "d": (False, "r", "e"), "e": (True, None, None)}
    with pytest.raises(ValueError, match="does not contain a table 'other'"):
        TB.open_table(spark, tmpdir_path, "other")
    with pytest.raises(FileNotFoundError, match="no tables at"):
        TB.open_table(spark, os.path.join(tmpdir_path, "none"), "annotation")


def test_a_workspace_reads_its_own_folder(spark, tmpdir_path):
    rows = [("007", 1), ("7", 2), ("a b!", 3), ("ab", 4), ("", 5), (None, 6), ("élan", 7)]
    TB.write_workspaces(spark.createDataFrame(rows, "name string, v int"), tmpdir_path, "name")
    read = lambda w: sorted(r.v for r in TB.read_workspace_table(spark, tmpdir_path, w).collect())
    assert (read("007"), read("7"), read("a b"), read(""), read("élan")) == ([1], [2], [3, 4], [5, 6], [7])
    files = TB.read_workspace_table(spark, tmpdir_path, "7").inputFiles()
    assert files and all("workspace=7/" in f for f in files)
    with pytest.raises(FileNotFoundError, match="no workspace 'x'"):
        TB.read_workspace_table(spark, tmpdir_path, "x")
    TB.write_workspace_table(spark.createDataFrame([("new", 8)], "name string, v int"), tmpdir_path, "7")
    assert read("7") == [8] and read("007") == [1]
