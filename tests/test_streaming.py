import json
import os

from pyspark.sql import functions as F

from themeflow.plans.streaming_jobs import q_stream_counts
from themeflow.sources.tables import BucketedTable, VersionedTable
from themeflow.streaming import streams as ST

WEEK = 7 * 86400


def put(folder, name, posts):
    """A payload file of (id, created_utc) posts."""
    os.makedirs(folder, exist_ok=True)
    kids = [{"kind": "t3", "data": {"id": i, "selftext": "x", "author": "u", "created_utc": t}} for i, t in posts]
    with open(os.path.join(folder, name), "w") as f:
        f.write(json.dumps({"query_id": "q", "source_priority": 1, "page_no": 0, "data": {"children": kids}}) + "\n")


def run(spark, root, table, name="posts", **kw):
    stream = ST.ingest_stream(spark, os.path.join(root, "in")).select("id", "status", "query_id", "created_utc")
    ST.run_available_now(stream, os.path.join(root, f"ckpt-{name}"),
                         ST.upsert_batches(table, "id", stream.schema, name, **kw), output_mode="append")


def ids(table):
    return sorted(r.id for r in table.read().collect())


def test_stream_ingest_dedupes_ids_and_upserts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    put(src, "p0.json", [("a", 1.7e9), ("b", 1.7e9)])
    put(src, "p1.json", [("b", 1.7e9), ("c", 1.7e9)])
    table = VersionedTable(spark, os.path.join(tmpdir_path, "posts"))
    run(spark, tmpdir_path, table)
    assert ids(table) == ["a", "b", "c"]


def test_older_posts_of_a_later_batch_are_kept(spark, tmpdir_path):
    table = VersionedTable(spark, os.path.join(tmpdir_path, "posts"))
    put(os.path.join(tmpdir_path, "in"), "p0.json", [("new", 1.7e9)])
    run(spark, tmpdir_path, table)
    put(os.path.join(tmpdir_path, "in"), "p1.json", [("old", 1.7e9 - WEEK), ("fresh", 1.7e9 + 60), ("none", None)])
    run(spark, tmpdir_path, table)
    assert ids(table) == ["fresh", "new", "none", "old"]


def test_other_writers_between_batches_lose_nothing(spark, tmpdir_path):
    table = VersionedTable(spark, os.path.join(tmpdir_path, "posts"))
    put(os.path.join(tmpdir_path, "in"), "p0.json", [("a", 1.0)])
    run(spark, tmpdir_path, table)
    other = table.read().withColumn("id", F.lit("other"))
    table.write(table.read().unionByName(other))
    put(os.path.join(tmpdir_path, "in"), "p1.json", [("b", 2.0)])
    run(spark, tmpdir_path, table)
    assert ids(table) == ["a", "b", "other"]
    # a second stream with a checkpoint of its own
    put(os.path.join(tmpdir_path, "in"), "p2.json", [("c", 3.0)])
    run(spark, tmpdir_path, table, "second")
    assert ids(table) == ["a", "b", "c", "other"]


def test_a_replayed_batch_changes_nothing(spark, tmpdir_path):
    table = VersionedTable(spark, os.path.join(tmpdir_path, "t"))
    batch = spark.createDataFrame([("a", 1)], "id string, v int")
    merge = ST.upsert_batches(table, "id", batch.schema, "s")
    merge(batch, 0)
    table.write(table.read().withColumn("v", F.lit(9)))
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    merge(spark.createDataFrame(batch.rdd.mapPartitions(count), batch.schema), 0)
    assert [tuple(r) for r in table.read().collect()] == [("a", 9)] and seen.value >= 1


def test_existing_rows_can_stay(spark, tmpdir_path):
    table = VersionedTable(spark, os.path.join(tmpdir_path, "t"))
    schema = spark.createDataFrame([("a", 1)], "id string, v int")
    merge = ST.upsert_batches(table, "id", schema.schema, "s", skip_existing=True)
    merge(schema, 0)
    merge(spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int"), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 3)]


def test_counts_of_a_table_stored_as_a_folder(spark, tmpdir_path):
    one = "/root/testdata/sf0.001"
    many = os.path.join(tmpdir_path, "sf")
    spark.read.parquet(f"{one}/events.parquet").repartition(3).write.parquet(f"{many}/events.parquet")
    got, want = (sorted(map(tuple, q_stream_counts(spark, d).collect())) for d in (many, one))
    assert got == want and got


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def bucketed(spark, root, n=200, buckets=16):
    table = BucketedTable(spark, root, ["id"], buckets)
    table.write(spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v")))
    return table


def test_a_merge_rewrites_touched_buckets_only(spark, tmpdir_path):
    table = bucketed(spark, os.path.join(tmpdir_path, "t"))
    before = table.folders()
    assert len(before) == 16
    table.merge(spark.createDataFrame([("7", 5)], "id string, v int"), name="one")
    after = table.folders()
    assert after.keys() == before.keys() and sum(after[b] != before[b] for b in after) == 1
    assert rows_of(table.read()) == sorted((str(i), 5 if i == 7 else 0) for i in range(200))
    assert rows_of(table.read(0)) == sorted((str(i), 0) for i in range(200))
    # a key that is new, one that is null, and the same name again
    table.merge(spark.createDataFrame([("new", 1), (None, 2)], "id string, v int"), name="two")
    assert table.merge(spark.createDataFrame([("7", 9)], "id string, v int"), name="one") == 1
    got = {r.id: r.v for r in table.read().collect()}
    assert (got["new"], got[None], got["7"], len(got)) == (1, 2, 5, 202)
    table.merge(spark.createDataFrame([("7", 9), ("8x", 9)], "id string, v int"), skip_existing=True)
    got = {r.id: r.v for r in table.read().collect()}
    assert (got["7"], got["8x"]) == (5, 9)


def test_streams_into_a_bucketed_table(spark, tmpdir_path):
    """Replays and writes of others lose nothing here either."""
    table = BucketedTable(spark, os.path.join(tmpdir_path, "posts"), ["id"], 4)
    put(os.path.join(tmpdir_path, "in"), "p0.json", [("a", 1.0), ("b", 1.0)])
    run(spark, tmpdir_path, table)
    table.write(table.read().unionByName(table.read().filter("id = 'a'").withColumn("id", F.lit("other"))))
    put(os.path.join(tmpdir_path, "in"), "p1.json", [("c", 2.0)])
    run(spark, tmpdir_path, table)
    assert ids(table) == ["a", "b", "c", "other"]
    batch = spark.createDataFrame([("z", 1)], "id string, v int")
    own = BucketedTable(spark, os.path.join(tmpdir_path, "own"), ["id"], 4)
    merge = ST.upsert_batches(own, "id", batch.schema, "s")
    merge(batch, 0)
    own.write(own.read().withColumn("v", F.lit(9)))
    merge(batch, 0)
    assert rows_of(own.read()) == [("z", 9)]


def test_empty_bucketed_table(spark, tmpdir_path):
    table = BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["id"])
    empty = spark.createDataFrame([], "id string, v int")
    table.write(empty)
    assert table.read().count() == 0 and table.read().columns == ["id", "v"]
    table.merge(empty)
    table.merge(spark.createDataFrame([("a", 1)], "id string, v int"))
    assert rows_of(table.read()) == [("a", 1)]


def changes(spark, rows):
    return spark.createDataFrame(rows, "item_id string, ts double, theme string, sentiment double, seq long").withColumn(
        "ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def test_changed_items_leave_their_old_cell(spark, tmpdir_path):
    """After each batch the counts are those of the items' last states."""
    day = 86400.0
    batches = [[("a", 0.0, "x", .1, 1), ("b", 0.0, "x", .1, 1), ("c", day, "y", None, 1)],
               [("a", 10.0, "y", .9, 3), ("a", 5.0, "z", .9, 2), ("d", 0.0, None, -.6, 1)],
               [("b", 3.0, "q", 0.0, 0), ("a", day, "y", .9, 4), ("c", day, "y", None, 2)], []]
    items = BucketedTable(spark, os.path.join(tmpdir_path, "items"), ["item_id"], 4)
    counts = BucketedTable(spark, os.path.join(tmpdir_path, "counts"), ST.CELL, 4)
    merge = ST.last_state_batches(items, counts, ["seq"])
    seen = []
    for n, rows in enumerate(batches):
        merge(changes(spark, rows), n)
        if n == 1:      # a replay, and one that broke off between the two tables
            merge(changes(spark, rows), n)
            broken = BucketedTable(spark, items.root, ["item_id"], 4)
            broken.holds = lambda name: False
            broken.merge = lambda *a, **k: None
            ST.last_state_batches(broken, counts, ["seq"])(changes(spark, rows), n)
        seen += rows
        last = {}
        for r in seen:
            if r[0] not in last or r[4] > last[r[0]][4]:
                last[r[0]] = r
        want = {}
        for _, ts, theme, s, _ in last.values():
            near = None if s is None else min((-1.0, -.5, 0.0, .5, 1.0), key=lambda b: abs(b - s))
            cell = (ts // day * day, theme or "Unclustered", near)
            want[cell] = want.get(cell, 0) + 1
        assert {tuple(r)[:3]: r.n for r in counts.read().filter("n > 0").collect()} == want
