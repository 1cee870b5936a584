"""Removal of long repeated byte strings, by a logarithmic family of suffix
arrays.

Batches of documents come in the order of their ids. Each gets a sparse suffix
array: of every ``length``-byte string it holds the suffix at one anchor, the
smallest of the string's k-byte pieces by hash (leftmost if equal), so equal
strings have equal anchors and one suffix in about 16 is kept. Suffixes are
sorted by a fingerprint of their first k bytes; an array is a sorted run per
bucket of the fingerprint space. A batch is merge-scanned against the runs of
all levels. Suffixes that meet there, or within the batch, can begin a long
match. Then the batch's array enters level 0, and two arrays of a level merge
into one of the next, so a suffix is rewritten a logarithmic number of times.

A level keeps for each suffix the chunk of texts that has it, as long as there
is only one; when a later batch meets such a suffix, that chunk is told.
Afterwards the surroundings of the suffixes that met (and no others) are
compared: all ``length``-byte strings around an anchor lie in its surroundings,
which go to the anchor's bucket, once per chunk and distinct surroundings. A
string is repeated if a smaller document has it too.

Texts are kept in chunks, compressed; a task holds one chunk or one bucket
(``bucket_keys`` suffixes or so). Blocks are packed numbers, so no row per
byte or suffix is shuffled, and a string that a third of all documents hold is
one entry per chunk.

A null or empty text has no bytes. Rows with one id are one document: neither
repeats the other. A null id is smaller than all others. Other columns are
ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.arrowtext import mix64, text_slices
from themeflow.llm.packed import bucket_of, cut_points, pack, record_batch, unpack
from themeflow.llm.stored import Stored

NULL_ID = -(1 << 63)
_LOW = np.uint64(0xFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SuffixSettings:
    length: int = 50
    piece: int = 20
    n_batches: int = 4
    chunk_bytes: int = 4 << 20
    bucket_keys: int = 800_000

    @property
    def window(self) -> int:
        """Pieces in a string."""
        return self.length - self.piece + 1


def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from every place: sums of powers
    by doubling, then scrambled."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    out, done, n = None, 0, len(data) - width + 1
    level, size, factor = _byte_values()[data], 1, _BASE
    rest = width
    while rest:
        if rest & 1:        # append a block of ``size`` bytes after the ones done
            block = level[done:done + n]
            out = block.copy() if out is None else out * factor_of(size) + block
            done += size
        rest >>= 1
        if rest:
            level = level[:-size] * factor_of(size) + level[size:]
            size *= 2
    return mix64(out)


def factor_of(size: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), size, 1 << 64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every place."""
    size = 1
    n = len(values) - width + 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size:width - size + n])


@dataclass
class Texts:
    """Some documents' bytes end to end."""
    doc_ids: np.ndarray
    lens: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, doc_ids: list[int], texts: list[str | None]) -> "Texts":
        raw = [(t or "").encode() for t in texts]
        return cls(np.array(doc_ids, np.int64), np.array([len(r) for r in raw], np.int64),
                   np.frombuffer(b"".join(raw), np.uint8))

    def anchors(self, s: SuffixSettings):
        """(first string, last string, key, document's place) of each anchor;
        strings are named by their first byte."""
        n = len(self.data) - s.length + 1
        empty = np.empty(0, np.int64)
        if n <= 0:
            return empty, empty, np.empty(0, np.uint64), empty
        pieces = rolling(self.data, s.piece)
        marked = (pieces & ~_LOW) | np.arange(len(pieces), dtype=np.uint64)
        at = (sliding_min(marked, s.window) & _LOW).astype(np.int64)
        del marked
        ends = np.cumsum(self.lens)
        inside = np.zeros(n + 1, np.int8)       # strings that do not cross an end
        long = self.lens >= s.length
        np.add.at(inside, (ends - self.lens)[long], 1)
        np.add.at(inside, (ends - s.length + 1)[long], -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(starts):
            return empty, empty, np.empty(0, np.uint64), empty
        own = at[starts]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        first, last = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1]
        doc = np.searchsorted(ends, first, "right")
        return first, last, mix64(pieces[own[cut]] + np.uint64(1)), doc


_CHUNK = "chunk long, doc_ids binary, lens binary, data binary, n_bytes long"


def chunks(docs: DataFrame, batch: int, s: SuffixSettings) -> DataFrame:
    size = s.chunk_bytes

    def code(batches):
        squeeze = zstandard.ZstdCompressor(level=5)
        task, k = (batch << 24) + TaskContext.get().partitionId(), 0
        for part in text_slices(batches, limit=size):
            t = Texts.of(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            yield record_batch([((task << 20) + k, pack(t.doc_ids), pack(t.lens), squeeze.compress(t.data.tobytes()),
                                 len(t.data))], _CHUNK)
            k += 1

    return docs.mapInArrow(code, _CHUNK)


def _texts(row: dict) -> Texts:
    return Texts(unpack(row["doc_ids"], np.int64), unpack(row["lens"], np.int64),
                 np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8))


_SUFFIXES = "bucket long, chunk long, keys binary, many binary"
_RUN = "bucket long, chunk long, keys binary, holders binary"


def suffix_arrays(stored_chunks: DataFrame, buckets: int, s: SuffixSettings) -> DataFrame:
    """Each chunk's suffixes, sorted: per bucket the distinct keys, and for
    each whether several documents of the chunk have it."""
    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _texts(row)
                _, _, key, doc = t.anchors(s)
                code = codes(key, buckets)
                order = np.lexsort((t.doc_ids[doc], code))
                code, ids = code[order], t.doc_ids[doc][order]
                runs = np.array(cut_points(code), np.int64).reshape(-1, 2)
                many = (ids[runs[:, 0]] != ids[runs[:, 1] - 1]).astype(np.uint8)
                code = code[runs[:, 0]]
                yield record_batch([(int(code[a] >> np.uint64(32)), row["chunk"], pack_keys(code[a:b]), pack(many[a:b]))
                                    for a, b in cut_points(code >> np.uint64(32))], _SUFFIXES)

    return stored_chunks.mapInArrow(rows, _SUFFIXES)


def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and a 32-bit place in it. Two suffixes with one code may differ;
    that only costs a comparison of their surroundings."""
    return (bucket_of(keys, buckets) << np.uint64(32)) | (mix64(keys) & _LOW)


def pack_keys(sorted_codes: np.ndarray) -> bytes:
    """The places of sorted codes of one bucket, by their differences."""
    return pack(np.diff((sorted_codes.astype(np.uint64) & _LOW).astype(np.uint32), prepend=np.uint32(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint32), dtype=np.uint32)


def merge_scan(new: pa.Table, levels: pa.Table) -> pa.Table:
    """One bucket: the batch's suffixes against the runs of all levels. Gives
    the batch's own run (no chunk), and per chunk the keys that met others."""
    rows = new.to_pylist()
    if not rows:
        return record_table([], _RUN)
    bucket = rows[0]["bucket"]
    blocks = [unpack_keys(r["keys"]) for r in rows]
    key = np.concatenate(blocks)
    chunk = np.repeat(np.array([r["chunk"] for r in rows], np.int64), [len(b) for b in blocks])
    many = np.concatenate([unpack(r["many"], np.uint8) for r in rows]) > 0
    run, at, count = np.unique(key, return_inverse=True, return_counts=True)
    met = count > 1
    met[at[many]] = True
    holder = np.empty(len(run), np.int64)
    holder[at] = chunk
    told: list[tuple[np.ndarray, np.ndarray]] = []
    for r in levels.to_pylist():
        old, holders = unpack_keys(r["keys"]), unpack(r["holders"], np.int64)
        place = np.minimum(np.searchsorted(run, old), len(run) - 1)
        hit = run[place] == old
        met[place[hit]] = True
        alone = hit & (holders >= 0)
        told.append((holders[alone], old[alone]))
    holder[met] = -1
    told.append((chunk[met[at]], key[met[at]]))
    out = [(bucket, None, pack_keys(run), pack(holder))]
    who, what = (np.concatenate([t[k] for t in told]) for k in (0, 1))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    out += [(bucket, int(who[a]), pack_keys(np.unique(what[a:b])), None)
            for a, b in cut_points(who)]
    return record_table(out, _RUN)


def merge_runs(one: pa.Table, two: pa.Table) -> pa.Table:
    """Two runs of a bucket as one; a key of both has no single holder."""
    rows = one.to_pylist() + two.to_pylist()
    key = np.concatenate([unpack_keys(r["keys"]) for r in rows])
    holders = np.concatenate([unpack(r["holders"], np.int64) for r in rows])
    run, at, count = np.unique(key, return_inverse=True, return_counts=True)
    holder = np.empty(len(run), np.int64)
    holder[at] = holders
    holder[count > 1] = -1
    return record_table([(rows[0]["bucket"], None, pack_keys(run), pack(holder))], _RUN)


def record_table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([record_batch(rows, schema)])


class SuffixIndex:
    """Levels of suffix arrays; level k has room for 2**k batches."""

    def __init__(self, docs: DataFrame, s: SuffixSettings):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.s, self.spark = s, docs.sparkSession
        self.buckets = max(1, -(-2 * total // (s.window + 1) // s.bucket_keys))
        self.levels: dict[int, Stored] = {}
        self.chunks: list[Stored] = []
        self.met: list[Stored] = []

    def _union(self, tables, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for t in tables:
            out = out.unionByName(t.read())
        return out

    def insert(self, docs: DataFrame) -> None:
        """A batch; its ids must be larger than all before."""
        own = Stored(chunks(docs, len(self.chunks), self.s), "suffix-chunks")
        old = self._union(self.levels.values(), _RUN).filter("chunk is null")
        scan = (suffix_arrays(own.read(), self.buckets, self.s).groupBy("bucket").cogroup(old.groupBy("bucket"))
                .applyInArrow(merge_scan, _RUN))
        scan = Stored(scan, "suffix-scan")
        self.chunks.append(own)
        self.met.append(scan)
        run, level = scan, 0
        while level in self.levels:
            other = self.levels.pop(level)
            pair = [t.read().filter("chunk is null").groupBy("bucket") for t in (other, run)]
            merged = Stored(pair[0].cogroup(pair[1]).applyInArrow(merge_runs, _RUN), "suffix-level")
            for t in (other, run):
                if t not in self.met:
                    t.drop()
            run, level = merged, level + 1
        self.levels[level] = run

    def all_chunks(self) -> DataFrame:
        return self._union(self.chunks, _CHUNK)

    def meetings(self) -> DataFrame:
        return self._union(self.met, _RUN).filter("chunk is not null").select("bucket", "chunk", "keys")


def _met_anchors(t: Texts, met: list[dict], buckets: int, s: SuffixSettings):
    """Anchors of a chunk whose suffix met others: first and last string,
    document's place, and bucket, in the order of buckets and places."""
    first, last, key, doc = t.anchors(s)
    code = codes(key, buckets)
    home = code >> np.uint64(32)
    wanted = [np.empty(0, np.uint64)] + [(np.uint64(r["bucket"]) << np.uint64(32)) | unpack_keys(r["keys"]).astype(
        np.uint64) for r in met]
    pick = np.flatnonzero(np.isin(code, np.concatenate(wanted)))
    pick = pick[np.argsort(home[pick], kind="stable")]
    return first[pick], last[pick], doc[pick], home[pick].astype(np.int64)


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans end to end, and where each begins there."""
    begin = np.cumsum(size) - size
    where = np.arange(int(size.sum())) + np.repeat(first - begin, size)
    return data[where], begin


def _groups(t: Texts, first, last, doc, s: SuffixSettings) -> tuple[np.ndarray, np.ndarray]:
    """(for each anchor the place of the anchor that speaks for it, whether it
    speaks): of equal surroundings in a chunk, one in the smallest document."""
    n = len(first)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    size = last - first + s.length
    strings = rolling(t.data, s.length)
    # equal first and last strings, and equal size: equal surroundings, as
    # any two strings overlap or touch in the middle (size < 2 * length)
    order = np.lexsort((t.doc_ids[doc], size, strings[last], strings[first]))
    a, b, c = strings[first][order], strings[last][order], size[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
    head = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    speaker = np.empty(n, np.int64)
    speaker[order] = head
    return speaker, speaker == np.arange(n)


_AROUND = "bucket long, chunk long, doc_ids binary, sizes binary, data binary"
_MASKS = "bucket long, chunk long, masks binary"


def surroundings(stored_chunks: DataFrame, met: DataFrame, buckets: int, s: SuffixSettings) -> DataFrame:
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdCompressor(level=3)
        out = []
        for row in left.to_pylist():
            t = _texts(row)
            first, last, doc, home = _met_anchors(t, right.to_pylist(), buckets, s)
            _, speaks = _groups(t, first, last, doc, s)
            first, last, doc, home = (x[speaks] for x in (first, last, doc, home))
            for a, b in cut_points(home):
                size = last[a:b] - first[a:b] + s.length
                out.append((int(home[a]), row["chunk"], pack(t.doc_ids[doc[a:b]]), pack(size.astype(np.uint8)),
                            squeeze.compress(_gather(t.data, first[a:b], size)[0].tobytes())))
        return record_table(out, _AROUND)

    left = stored_chunks.select("chunk", "doc_ids", "lens", "data")
    return left.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(rows, _AROUND)


def compare(around: DataFrame, s: SuffixSettings) -> DataFrame:
    """Per chunk and bucket a bit mask for each of its surroundings: which of
    its strings a smaller document has."""
    def rows(t: pa.Table) -> pa.Table:
        inflate = zstandard.ZstdDecompressor()
        own = t.to_pylist()
        strings, docs, owner, place, lens = [], [], [], [], []
        for k, r in enumerate(own):
            ids, size = unpack(r["doc_ids"], np.int64), unpack(r["sizes"], np.uint8).astype(np.int64)
            hashes = rolling(np.frombuffer(inflate.decompress(r["data"]), np.uint8), s.length)
            n = size - s.length + 1
            begin = np.cumsum(size) - size
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            strings.append(hashes[np.repeat(begin, n) + within])
            docs.append(np.repeat(ids, n))
            owner.append(np.repeat(np.arange(len(ids)), n))
            place.append(within)
            lens.append(len(ids))
        _, at = np.unique(np.concatenate(strings), return_inverse=True)
        doc = np.concatenate(docs)
        least = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, at, doc)
        repeated = least[at] < doc
        out, lo = [], 0
        for r, who, where, n in zip(own, owner, place, lens):
            hit = repeated[lo:lo + len(who)]
            lo += len(who)
            masks = np.zeros(n, np.uint64)
            np.bitwise_or.at(masks, who[hit], np.uint64(1) << where[hit].astype(np.uint64))
            out.append((r["bucket"], r["chunk"], pack(masks)))
        return record_table(out, _MASKS)

    return around.groupBy("bucket").applyInArrow(rows, _MASKS)


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _apply_masks(stored_chunks: DataFrame, masks: DataFrame, met: DataFrame, buckets: int,
                 s: SuffixSettings) -> DataFrame:
    told = met.select("chunk", "bucket", "keys", F.lit(None).cast("binary").alias("masks")).unionByName(
        masks.select("chunk", "bucket", F.lit(None).cast("binary").alias("keys"), "masks"))

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        told = right.to_pylist()
        for row in left.to_pylist():
            t = _texts(row)
            first, last, doc, _ = _met_anchors(t, [r for r in told if r["keys"] is not None], buckets, s)
            speaker, speaks = _groups(t, first, last, doc, s)
            own = np.zeros(len(first), np.uint64)
            answers = [unpack(r["masks"], np.uint64) for r in sorted(
                (r for r in told if r["masks"] is not None), key=lambda r: r["bucket"])]
            if answers:
                own[speaks] = np.concatenate(answers)
            # equal surroundings in a larger document of the chunk: all repeated
            later = t.doc_ids[doc] > t.doc_ids[doc[speaker]] if len(doc) else np.empty(0, bool)
            mask = np.where(later, ~np.uint64(0), own[speaker] if len(doc) else own)
            n = last - first + 1
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = (np.repeat(mask, n) >> within.astype(np.uint64)) & np.uint64(1)
            starts = (np.repeat(first, n) + within)[hit == 1]
            edge = np.zeros(len(t.data) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + s.length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out += _documents(t, gone)
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        return pa.table({c: pa.array([o[k] for o in out], kinds[k]) for k, c in enumerate(names)})

    left = stored_chunks.select("chunk", "doc_ids", "lens", "data")
    return left.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(rows, _RESULT)


def _documents(t: Texts, gone: np.ndarray) -> list[tuple]:
    out, lo = [], 0
    for doc, n in zip(t.doc_ids.tolist(), t.lens.tolist()):
        own = gone[lo:lo + n]
        spans, kept = [], t.data[lo:lo + n]
        if own.any():
            edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            kept = kept[~own]
        out.append((None if doc == NULL_ID else doc, n, spans, kept.tobytes()))
        lo += n
    return out


def remove_repeats(docs: DataFrame, s: SuffixSettings = SuffixSettings(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, the removed spans of bytes, and
    the remaining bytes."""
    docs = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    index = SuffixIndex(docs, s)
    parts = [k / s.n_batches for k in range(1, s.n_batches)]
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", parts)).first()[0] or [])) if parts else []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = docs
        if lo is not None:
            batch = batch.filter(F.col("doc_id") > lo)
        if hi is not None:
            batch = batch.filter(F.col("doc_id") <= hi)
        index.insert(batch)
    around = surroundings(index.all_chunks(), index.meetings(), index.buckets, s)
    masks = Stored(compare(around, s), "suffix-masks")
    for level in index.levels.values():
        if level not in index.met:
            level.drop()
    return _apply_masks(index.all_chunks(), masks.read(), index.meetings(), index.buckets, s)


def digest(cleaned: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeats``."""
    return cleaned.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> list[tuple]:
    """What ``digest(remove_repeats(...))`` must give, for tests."""
    least: dict[bytes, int] = {}
    raw = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
