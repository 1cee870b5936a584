"""State changes send each stored row through one shuffle."""

import re

from pyspark.sql import functions as F

from themeflow.operators import state as SM
from themeflow.sources.tables import BucketedTable

COLS = ("item_id string, item_type string, sentiment double, summary string, raw_tag string, is_substantive boolean, "
        "reception_reason string, consolidated_tag string, cluster_explanation string, cluster_id int, embedding array<float>")


def annotations(spark, ids):
    return spark.createDataFrame([(i, "comment", 0.1, "s", "t", True, "r", "c", "e", 7, [1.0]) for i in ids], COLS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bulk_edit_reads_stored_rows_once_and_sorts_them_after_the_shuffle_alone(spark, tmp_path):
    annotations(spark, ["a", "b", "b", "c", None, None]).write.parquet(f"{tmp_path}/ann")
    items = spark.createDataFrame([(i, "pending") for i in ("a", "a", "b", "d", "x", None)], "id string, status string")
    out = SM.bulk_annotate(items, spark.read.parquet(f"{tmp_path}/ann"), ["a", "b", "d", "zz"], "post", 0.5, "new", True)[1]
    text = plan(out)
    assert text.count("FileScan parquet") == 1 and "WindowGroupLimit" not in text
    got = {r.item_id: (r.item_type, r.sentiment, r.summary, r.raw_tag, r.cluster_id) for r in out.collect()}
    stored = ("comment", 0.1, "s", "t", 7)
    edited = ("comment", 0.5, SM.S.BULK_EDIT_SUMMARY, "new", 7)
    assert out.count() == 5
    assert got == {"a": edited, "b": edited, "c": stored, None: stored, "d": ("post", 0.5, SM.S.BULK_NEW_SUMMARY, "new", None)}


def test_merge_deals_rows_by_bucket_once(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, f"{tmp_path}/t", ["item_id"], 4)
    table.write(annotations(spark, [f"i{n}" for n in range(50)] + ["i3", None, None]))
    seen, put = [], BucketedTable._put
    monkeypatch.setattr(BucketedTable, "_put", lambda self, df, *a: seen.append(plan(df)) or put(self, df, *a))
    table.merge(annotations(spark, ["i3", "i4", "new"]).withColumn("raw_tag", F.lit("written")))
    got = sorted((r.item_id, r.raw_tag) for r in table.read().collect() if r.item_id is not None)
    assert got == sorted([(f"i{n}", "written" if n in (3, 4) else "t") for n in range(50)] + [("new", "written")])
    assert len(re.findall("Exchange", seen[0])) == 1 and "__bucket" in seen[0] and "WindowGroupLimit" not in seen[0]
    table.merge(annotations(spark, ["i3", "more"]).withColumn("raw_tag", F.lit("late")), skip_existing=True)
    got = {r.item_id: r.raw_tag for r in table.read().collect()}
    assert got["i3"] == "written" and got["more"] == "late"


def test_upsert_takes_the_last_of_many_writes(spark):
    base = annotations(spark, ["a", "b"])
    writes = annotations(spark, ["a"]).withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(500))))
    writes = writes.withColumn("sentiment", F.col("seq").cast("double"))
    out = SM.upsert(base, writes, "item_id", "seq")
    assert plan(out).count("WindowGroupLimit") <= 2  # on the writes alone
    assert sorted((r.item_id, r.sentiment) for r in out.collect()) == [("a", 500.0), ("b", 0.1)]


def test_merge_leaves_no_shuffle_files_and_chooses_comments_by_keys(spark, tmp_path):
    import os
    import time

    from pyspark.sql import types as T

    from themeflow.plans import maintenance as M
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        names = [f for top in folders for _, _, files in os.walk(top) for f in files]
        return {f.split("_")[1] for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffles()
    table = BucketedTable(spark, f"{tmp_path}/t", ["item_id"], 4)
    table.write(annotations(spark, [f"i{n}" for n in range(50)]))
    table.merge(SM.last_per_key(annotations(spark, ["i3", "i4", "new"]).withColumn("seq", F.lit(1)), "item_id", "seq").drop("seq"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    # the buckets of the writes were looked up in a shuffle of their numbers alone
    assert len(shuffles() - before) <= 1 and table.read().count() == 51
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"

    day = "timestamp '1996-09-13'"
    li = spark.sql(f"""select * from values (1L, 7L, 3L, 1, 0.1d, 0.02d, 'A', 'O', {day}), (1L, 7L, 3L, 1, 0.2d, 0.02d, 'N', 'O', {day}),
        (2L, 8L, 3L, 1, 0.3d, 0.02d, 'N', 'O', {day}), (3L, null, 3L, 1, 0.4d, 0.02d, 'A', 'O', {day})
        as t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.sql("select * from values (7L, 'n', 't', 'b', 5), (7L, 'm', 't', 'b', 6) as t(p_partkey, p_name, p_type, p_brand, p_size)")
    part.write.parquet(f"{tmp_path}/part.parquet")
    ev = spark.sql(f"select 1L event_id, 'click' event_type, 2.0d value, {day} ts, 'p' props")
    ev.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], T.StructType([T.StructField("o_orderkey", T.LongType())])).write.parquet(f"{tmp_path}/orders.parquet")
    out = M._updates(spark, str(tmp_path))
    got = sorted((r.item_id, r.sentiment, r.consolidated_tag, r.seq) for r in out.collect())
    i = "l1-1-7-3-19960913"  # the row with the same key, and each part of two, has its writes; a key with a null has none
    assert got == [("e1", 2.0 / 50 - 1, "click", 3)] + sorted([(i, s, x.upper() if s > 0 else x, q) for s, q in ((-1.0, 1), (1.0, 2)) for x in "mn"] * 2)
    assert not re.search(r"SortMergeJoin \[item_id|BroadcastHashJoin \[item_id", plan(out))
