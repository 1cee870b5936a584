"""Incremental, reversible line de-duplication.

State, all tables in a shared folder:

* postings ``(key, doc_id, n_rows)``: exact, for deletions and decisions;
* reference counts ``(batch, shard, key, n_docs, first_doc, last_doc,
  maybe_old)``: exact, a row per key and batch; a deletion adds negative rows;
* one cuckoo filter per shard and batch.

``insert`` counts a batch's keys with map-side partial sums (so a very common
line is one row per task and never a group), then asks each shard's filters
whether a key may be in the index already. Only keys flagged so, or held by two
documents of the batch, can be duplicates: the exact counts are looked up for
these alone, all other lines never reach the joins. ``delete`` takes documents
out again: counts fall, and keys that nothing holds leave their filters.

A key is the 128-bit hash of a line stripped of ASCII white space and with A-Z
lower-cased; lines under ``min_chars`` code points have none. Rows with one id
are one document; a null id is one document before all others; null and empty
texts are one empty line. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow.llm.arrowtext import WORD_SPACE, text_slices, whole_texts
from themeflow.llm.cuckoo import CuckooFilter
from themeflow.llm.stored import Stored

#: Stands for a null id inside the index: before all others.
NULL_ID = -(1 << 63)
#: Keys of a batch that one shard gets, about; bounds a task's memory.
KEYS_PER_SHARD = 200_000
_KEY = pa.binary()


def line_keys(texts: pa.Array, min_chars: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """All lines, the key of each (null: too short), lines per text."""
    parts = pc.split_pattern(whole_texts(texts), "\n")
    lines = parts.flatten()
    counts = np.diff(parts.offsets.to_numpy())
    plain = pc.ascii_lower(pc.ascii_trim(lines, characters=WORD_SPACE))
    coded = pc.if_else(pc.greater_equal(pc.utf8_length(plain), min_chars), plain, None).dictionary_encode()
    keys = pa.array([xxhash.xxh3_128_digest(k) for k in coded.dictionary.to_pylist()], _KEY)
    return lines, keys.take(coded.indices), counts


def _postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    def rows(batches):
        for part in text_slices(batches, text_col):
            _, keys, counts = line_keys(part.column(text_col), min_chars)
            owner = np.repeat(np.arange(part.num_rows), counts)
            pairs = pa.table({"row": owner, "key": keys}).filter(pc.is_valid(keys))
            pairs = pairs.group_by(["row", "key"]).aggregate([])
            ids = part.column("__id").take(pairs["row"].combine_chunks())
            yield from pa.table({"key": pairs["key"], "doc_id": ids}).to_batches()

    return (docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("__id"), text_col)
            .mapInArrow(rows, "key binary, doc_id long"))


def _hashes(keys: pa.Array) -> np.ndarray:
    """The first 64 bits of each key."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)
    return raw[::2].copy()


def _flag(batch: int):
    """One shard's keys against its filters; also gives the batch's filter."""
    def run(new: pa.Table, filters: pa.Table) -> pa.Table:
        new = new.sort_by("key")
        keys = new["key"].combine_chunks()
        hashes = _hashes(keys)
        maybe = np.zeros(len(keys), bool)
        for blob in filters["blob"].to_pylist():
            maybe |= CuckooFilter.from_bytes(blob).contains(hashes)
        own = CuckooFilter.sized_for(len(keys))
        own.insert(hashes)
        shard = (new["shard"] if len(keys) else filters["shard"])[0].as_py()
        n = len(keys)
        return pa.table({
            "batch": pa.array([batch] * (n + 1), pa.int32()),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "key": pa.array(keys.to_pylist() + [None], pa.binary()),
            **{c: pa.array(new[c].to_pylist() + [None], pa.int64()) for c in ("n_docs", "first_doc", "last_doc")},
            "maybe_old": pa.array(maybe.tolist() + [None], pa.bool_()),
            "blob": pa.array([None] * n + [own.to_bytes()], pa.binary())})
    return run


_STATE = ("batch int, shard int, key binary, n_docs long, first_doc long, last_doc long, maybe_old boolean, "
          "blob binary")


class LineIndex:
    def __init__(self, spark: SparkSession, min_chars: int = 10, id_col: str = "doc_id",
                 text_col: str = "text", n_shards: int | None = None):
        self.spark, self.min_chars, self.id_col, self.text_col = spark, min_chars, id_col, text_col
        self.n_shards = n_shards
        self.batches = 0
        self._postings: list[Stored] = []
        self._state: list[Stored] = []      # counts and filters of each batch

    def _union(self, tables: list[Stored], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for t in tables:
            out = out.unionByName(t.read())
        return out

    def postings(self) -> DataFrame:
        return self._union(self._postings, "key binary, doc_id long")

    def _rows(self) -> DataFrame:
        return self._union(self._state, _STATE)

    def counts(self) -> DataFrame:
        """Exact reference counts: a row per batch and key."""
        return self._rows().filter(F.col("blob").isNull()).drop("blob")

    def filters(self) -> DataFrame:
        return self._rows().filter(F.col("blob").isNotNull()).select("batch", "shard", "blob")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.n_shards)).cast("int"))

    def insert(self, docs: DataFrame) -> None:
        posts = Stored(_postings(docs, self.id_col, self.text_col, self.min_chars), "line-postings")
        if self.n_shards is None:
            self.n_shards = max(8, -(-posts.read().count() // KEYS_PER_SHARD))
        new = self._sharded(posts.read().groupBy("key").agg(
            F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc")))
        flagged = (new.groupBy("shard").cogroup(self.filters().groupBy("shard"))
                   .applyInArrow(_flag(self.batches), _STATE))
        self._state.append(Stored(flagged, "line-counts"))
        self._postings.append(posts)
        self.batches += 1

    def delete(self, ids: DataFrame) -> None:
        """Take the documents with these ids (column ``id_col``) out."""
        gone = ids.select(F.coalesce(F.col(self.id_col), F.lit(NULL_ID)).cast("long").alias("doc_id")).distinct()
        lost_posts = Stored(self.postings().join(gone, "doc_id", "left_semi").select("key", "doc_id"), "line-lost")
        kept = Stored(self.postings().join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-postings")
        lost = lost_posts.read().select("key").distinct()
        left = kept.read().groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        # counts of touched keys start anew from what is left; keys without
        # any document go, also from the filters
        rows = self.counts().join(lost.withColumn("touched", F.lit(True)), "key", "left")
        same = rows.filter("touched is null").drop("touched")
        touched = rows.filter("touched")
        again = (touched.join(left, "key")
                 .groupBy("key", "shard", "n", "first", "last")
                 .agg(F.min("batch").alias("batch"), F.max("maybe_old").alias("maybe_old"))
                 .select("batch", "shard", "key", F.col("n").alias("n_docs"), F.col("first").alias("first_doc"),
                         F.col("last").alias("last_doc"), "maybe_old"))
        # a key that stays keeps the entry of its first batch only
        first = again.select("key", F.col("batch").alias("home"))
        dead = (touched.join(first, "key", "left").filter("home is null or batch != home")
                .select("batch", "shard", "key"))

        def prune(filters: pa.Table, keys: pa.Table) -> pa.Table:
            blobs = []
            for blob in filters["blob"].to_pylist():
                f = CuckooFilter.from_bytes(blob)
                if len(keys):
                    f.remove(_hashes(keys["key"].combine_chunks()))
                blobs.append(f.to_bytes())
            return filters.set_column(filters.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))

        filters = (self.filters().groupBy("batch", "shard").cogroup(dead.groupBy("batch", "shard"))
                   .applyInArrow(prune, "batch int, shard int, blob binary"))
        state = same.unionByName(again).unionByName(filters, allowMissingColumns=True)
        self._state = [Stored(state, "line-counts")]
        self._postings = [kept]

    def shared(self) -> DataFrame:
        """Keys in two or more documents, with the smallest id of them."""
        counts = self.counts()
        suspects = counts.filter("maybe_old or first_doc < last_doc").select("key").distinct()
        return (counts.join(suspects, "key", "left_semi")
                .groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"),
                                    F.max("last_doc").alias("last_doc"))
                .filter("first_doc < last_doc").select("key", "n_docs", "first_doc"))

    def drops(self) -> DataFrame:
        """For each document that loses lines, the keys that go."""
        return (self.postings().join(self.shared(), "key").filter("doc_id > first_doc")
                .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """``docs`` with duplicate lines gone from the text, and the counts in
        a column ``__lines`` (n_lines, n_dropped)."""
        drops = self.drops().select(F.col("doc_id").alias("__id"), F.col("keys").alias("__keys"))
        wide = (docs.withColumn("__id", F.coalesce(F.col(self.id_col), F.lit(NULL_ID)).cast("long"))
                .join(drops, "__id", "left").drop("__id"))
        schema = T.StructType(docs.schema.fields + [T.StructField("__lines", T.StructType([
            T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))])
        text_col, min_chars, columns = self.text_col, self.min_chars, docs.columns

        def rebuild(batches):
            for part in text_slices(batches, text_col):
                lines, keys, counts = line_keys(part.column(text_col), min_chars)
                lines, keys = lines.to_pylist(), keys.to_pylist()
                texts, dropped, lo = part.column(text_col).to_pylist(), [], 0
                for row, (n, gone) in enumerate(zip(counts.tolist(), part.column("__keys").to_pylist())):
                    if gone:
                        gone = set(gone)
                        left = [x for x, k in zip(lines[lo:lo + n], keys[lo:lo + n]) if k not in gone]
                        texts[row] = "\n".join(left)
                        dropped.append(n - len(left))
                    else:
                        dropped.append(0)
                    lo += n
                arrays = {c: part.column(c) for c in columns}
                arrays[text_col] = pa.array(texts, part.schema.field(text_col).type)
                arrays["__lines"] = pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["n_lines", "n_dropped"])
                yield pa.RecordBatch.from_pydict(arrays)

        return wide.select(*columns, "__keys").mapInArrow(rebuild, schema)


def halves(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """The documents as two batches, by the median id (nulls in the first)."""
    middle = docs.select(F.percentile_approx(id_col, 0.5)).first()[0]
    if middle is None:
        return [docs]
    return [docs.filter(F.col(id_col).isNull() | (F.col(id_col) <= middle)), docs.filter(F.col(id_col) > middle)]


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents through a new index, in two batches; see ``cleaned``."""
    index = LineIndex(docs.sparkSession, min_chars, id_col, text_col)
    for batch in halves(docs, id_col):
        index.insert(batch)
    return index.cleaned(docs)


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of ``cleaned`` documents."""
    return docs.select("doc_id", F.col("__lines.n_lines").alias("n_lines"),
                       F.col("__lines.n_dropped").alias("n_dropped"),
                       F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = 10) -> list[tuple]:
    """What ``digest(dedup_lines(...))`` must give, for tests; unique ids."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WORD_SPACE).translate(fold)
    first: dict[str, int] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out
