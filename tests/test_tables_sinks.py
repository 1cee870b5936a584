import os

from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators import state as SM
from themeflow.sources import sinks as SK
from themeflow.sources.tables import VersionedTable, read_workspace_table, workspace_name, write_workspace_table


def test_versioned_table_roundtrip(spark, tmpdir_path):
    t = VersionedTable(spark, os.path.join(tmpdir_path, "ann"))
    assert t.latest() is None
    v0 = t.init(S.ANNOTATIONS)
    assert v0 == 0 and t.read().count() == 0
    rows = spark.createDataFrame([("a", "post", 0.5, "s", "t", True, "r", "x", None, 1, None)], S.ANNOTATIONS)
    v1 = t.write(SM.upsert(t.read(), rows, "item_id"))
    assert v1 == 1 and t.read().count() == 1
    assert t.write(rows, 1) == 1  # replaying a committed version is a no-op


def test_upsert_empty_update_is_identity_and_last_write_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    empty = spark.createDataFrame([], "k string, v int, seq int")
    assert sorted(SM.upsert(base, empty, "k", "seq").collect()) == sorted(base.collect())
    upd = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 1)], "k string, v int, seq int")
    got = sorted(tuple(r) for r in SM.upsert(base, upd, "k", "seq").collect())
    assert got == [("a", 7), ("b", 2), ("c", 9)]


def test_reset_failed_twice_equals_once(spark):
    items = spark.createDataFrame([("a", "failed"), ("b", "processed")], "id string, status string")
    once = SM.reset_failed(items)
    assert sorted(once.collect()) == sorted(SM.reset_failed(once).collect())


def test_workspace_partition(spark, tmpdir_path):
    assert workspace_name("jake & amy!") == "jakeamy" and workspace_name("") == "default"
    root = os.path.join(tmpdir_path, "ws")
    df = spark.createDataFrame([("a",)], "id string")
    write_workspace_table(df, root, "one")
    write_workspace_table(df.withColumn("id", F.lit("b")), root, "two")
    assert [r.id for r in read_workspace_table(spark, root, "two").collect()] == ["b"]
    assert [r.id for r in read_workspace_table(spark, root, "one").collect()] == ["a"]


def test_exports(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "x|y")], "id string, text string")
    assert SK.export_csv(df.limit(0), os.path.join(tmpdir_path, "none")) is False
    assert SK.export_csv(df, os.path.join(tmpdir_path, "csv"))
    assert SK.export_json(df, os.path.join(tmpdir_path, "json"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).collect()
    assert [tuple(r) for r in back] == [("a", "x|y")]


def test_markdown_lines(spark):
    summary = spark.createDataFrame([("a|b", 62.5, "e|f", 5), ("c", 37.5, "", 3)],
                                    "consolidated_tag string, cluster_dominance_percent double, "
                                    "consolidated_tag_explanation string, items_in_theme long")
    lines = [r.value for r in SK.summary_markdown_lines(summary).orderBy("line_no").collect()]
    assert lines[2] == "| a\\|b | 62.5% | e\\|f |"
    assert lines[3] == "| c | 37.5% |  |"
