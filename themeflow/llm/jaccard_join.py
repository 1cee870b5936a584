"""Similarity join of documents on the Jaccard index of their word shingles.

Prefix filtering under several global token orders. If two sets have an index
of at least t, then under *any* one order of all tokens the first
``n - ceil(t * n) + 1`` tokens of both have one in common. So a document takes
part only if, under every order, it shares a prefix token with another
document of a fitting size that passed the orders before:

1. common tokens last, by how common, then by hash;
2. the same with another hash, over the documents that passed order 1.

Which tokens are common is counted on the prefixes by hash of one set in
``COMMON_SAMPLE`` (a bounded list of the ``common_tokens`` most frequent; any
order is valid, so no result depends on it, only how few pairs are tried).

Equal sets are one row from the start, under a 64-bit set id. Rows of order 2
carry a sketch: how many tokens fall in each of 256 parts of the hash space. The
differences of two sketches add up to no more than the sets' symmetric
difference, so most members of a bucket that only share a passage are told
apart within the bucket, exactly; a fine sketch (a part for 16 to 32 tokens) and
then a dense one (for 1 or 2) do the same for the pairs that are left, so that
whole sets, 25 times as large, travel with few pairs but links.

Within the bucket of a prefix token no pairs of similar sets are listed: a hub
is tried with the rest, and links found
join components. What remains is exact: members of one bucket whose sizes and
sketches fit and whose components still differ are tried one with another, so
no link between components is missed. (``best_rounds`` before that try each
member with the likeliest of each other component only, which joins most, so
that few pairs are left.) Members of the component that most of a
bucket belongs to are tried with the others only, never among themselves. A
bucket of more than ``run_limit`` members is dealt out: hub rounds go on over
salted parts of it, one hub for a member, as long as they join the most of it;
what stays outside the main component then meets the bucket piece by piece, a
task for two pieces. Pairs are then tested for a shared prefix
token under both orders, and for the index itself on the whole sets.

Tokens: words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a set has the distinct
``k``-word shingles, or the whole sequence if there are fewer words. A text
that is null, empty or without words has an empty set and no links. Rows with
one id and different texts are in the output one by one; a null id is the
smallest. Other columns are ignored, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.arrowtext import hash_words, mix64, signed, split_words, text_slices
from themeflow.llm.components import connected_components
from themeflow.llm.stored import Stored, free_shuffles

NULL_ID = -(1 << 63)
#: Members of a bucket that are looked at together.
PIECE = 1 << 16
#: Parts of the hash space that a sketch counts.
PARTS = 256
#: Parts of a long run in a hub round.
SALTED = 64
#: One set in so many shows which tokens are common.
COMMON_SAMPLE = 8
#: Tokens that travel with the pairs verified at once: half of all sets', or this.
LEAST_VERIFIED = 1 << 22
#: Hashes of the two orders that put common tokens last.
SALTS = (1, 2)


@dataclass(frozen=True)
class JoinSettings:
    k: int = 4
    percent: int = 85
    common_tokens: int = 1 << 20
    common_from: int = 2
    hub_rounds: int = 1
    best_rounds: int = 0
    broadcast_ids: int = 1 << 18
    run_limit: int = 1 << 14


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = split_words(texts, lower=True)
    hashes = hash_words(words)
    n = len(hashes)
    rolled = np.empty(0, np.uint64)
    if n >= k:
        rolled = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n - k + 1 + i])
    out, lo = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[lo:lo + c - k + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[lo:lo + c].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        lo += c
    return out


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_length(n, percent: int):
    """Any two sets that fit share a token among so many first ones."""
    return n + (-percent * n // 100) + 1


def prefix(tokens: np.ndarray, percent: int, salt: int, common: np.ndarray | None = None,
           commonness: np.ndarray | None = None) -> np.ndarray:
    """The first tokens in the order of ``salt``, common ones last."""
    p = prefix_length(len(tokens), percent)
    key = mix64(tokens + np.uint64(salt)) if salt else tokens
    if common is None or not len(common):
        return tokens[np.argpartition(key, p - 1)[:p]] if p < len(tokens) else tokens
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    weight = np.where(common[at] == tokens, commonness[at], 0)
    return tokens[np.lexsort((key, weight))[:p]]


_ROWS = "token long, sid long, n int"


def sketch(tokens: np.ndarray, parts: int) -> bytes:
    """Tokens in each of so many parts (a power of two) of the hash space;
    255 stands for more, too."""
    shift = np.uint64(65 - parts.bit_length())
    return np.minimum(np.bincount((tokens >> shift).astype(np.int64), minlength=parts), 255).astype(
        np.uint8).tobytes()


def fine_parts(n: int) -> int:
    """Parts of the fine sketch of a set: 16 to 32 tokens in each."""
    return max(PARTS, 1 << (n // 32).bit_length())


def dense_parts(n: int) -> int:
    """Parts of the dense sketch of a set: 1 or 2 tokens in each, so that few
    differences hide."""
    return max(PARTS, 1 << n.bit_length() - 1)


def _sketch_if_finer(tokens: np.ndarray, parts: int) -> bytes | None:
    """Parts of mostly few tokens take about 2 bits each when compressed."""
    return zstandard.ZstdCompressor(level=1).compress(sketch(tokens, parts)) if parts > PARTS else None


def fine_gap(a: bytes, b: bytes) -> int:
    """What two fine or dense sketches say at least of the symmetric
    difference; the finer one is folded to the parts of the other."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        if y.max() == 255:      # more, perhaps: sums would not be bounds
            return 0
        y = np.minimum(y.reshape(len(x), -1).sum(axis=1), 255)
    return int(np.abs(x - y).sum())


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)),
        pa.array(signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)))


def members(docs: DataFrame, s: JoinSettings) -> DataFrame:
    """Per document: id, ``print`` (as it came), set id (null: empty), size,
    and the prefix by hash of the sampled sets."""
    k, percent = s.k, s.percent

    def rows(batches):
        for part in text_slices(batches):
            sets = shingle_sets(part.column("text"), k)
            ids = [set_id(t) if len(t) else None for t in sets]
            none = np.empty(0, np.uint64)
            first = [prefix(t, percent, 0) if i is not None and not i % COMMON_SAMPLE else none for i, t in zip(ids, sets)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("print"), pa.array(ids, pa.int64()),
                 pa.array([len(t) for t in sets], pa.int64()), _longs(first)], ["doc_id", "print", "sid", "n", "first"])

    return docs.mapInArrow(rows, "doc_id long, print long, sid long, n long, first array<long>")


def features(docs: DataFrame, s: JoinSettings, common) -> DataFrame:
    """One row per set: id, size, sketch, fine and dense sketch (null: no finer
    than the first), prefixes under orders 1 and 2.
    ``common`` is a broadcast of (sorted tokens, how common)."""
    k, percent = s.k, s.percent

    def rows(batches):
        table = common.value
        for part in text_slices(batches):
            sets = list({set_id(t): t for t in shingle_sets(part.column("text"), k) if len(t)}.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in sets], pa.int64()), pa.array([len(t) for _, t in sets], pa.int32()),
                 pa.array([sketch(t, PARTS) for _, t in sets], pa.binary()),
                 *(pa.array([_sketch_if_finer(t, parts(len(t))) for _, t in sets], pa.binary())
                   for parts in (fine_parts, dense_parts)),
                 *(_longs([prefix(t, percent, z, *table) for _, t in sets]) for z in SALTS)],
                ["sid", "n", "sketch", "fine", "dense", "first1", "first2"])

    return docs.select("text").mapInArrow(
        rows, "sid long, n int, sketch binary, fine binary, dense binary, first1 array<long>, "
              "first2 array<long>").dropDuplicates(["sid"])


def _values(column: pa.Array) -> np.ndarray:
    """Numbers as an array, sketches as a matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)
    return column.to_numpy(zero_copy_only=False)


def _runs(batches, make):
    """Feed ``make`` with the runs of equal tokens of a sorted partition, in
    pieces of at most PIECE members (a long run's pieces share a member)."""
    held: list[dict] = []
    size = 0

    def flush(keep_last: bool):
        nonlocal held, size
        table = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        token = table["token"]
        cut = len(token)
        if keep_last:
            cut = int(np.searchsorted(token, token[-1], "left")) if token[0] != token[-1] else len(token)
        if cut == len(token) and keep_last and cut < PIECE:
            held, size = [table], cut
            return None
        rest = {c: v[cut:] for c, v in table.items()} if cut < len(token) else {c: v[-1:] for c, v in table.items()}
        held, size = ([rest], len(rest["token"])) if keep_last else ([], 0)
        return make({c: v[:cut] for c, v in table.items()})

    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE):
            part = batch.slice(lo, PIECE)
            held.append({c: _values(part.column(c)) for c in part.schema.names})
            size += part.num_rows
            if size >= PIECE:
                out = flush(True)
                if out is not None:
                    yield out
    if size:
        out = flush(False)
        if out is not None:
            yield out


def _fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small.astype(np.int64) >= percent * large.astype(np.int64)


def _sorted_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", "n", "sid")


def shared_rows(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """The rows (token, sid, n) that share their token with another set of a
    fitting size: in the order of sizes, a neighbour fits if any set does."""
    percent, names = s.percent, ["token", "sid", "n"]

    def scan(batches):
        def make(t):
            keep = np.r_[True, (t["token"][1:] != t["token"][:-1]) | (t["sid"][1:] != t["sid"][:-1])]
            token, n = t["token"][keep], t["n"][keep]
            near = (token[1:] == token[:-1]) & _fits(n[:-1], n[1:], percent)
            has = np.flatnonzero(keep)[np.r_[near, False] | np.r_[False, near]]
            return pa.RecordBatch.from_arrays([pa.array(t[c][has]) for c in names], names)
        yield from _runs(batches, make)

    return _sorted_buckets(rows.select(*names)).mapInArrow(scan, _ROWS)


def _partners(first: np.ndarray, until: np.ndarray):
    """(i, j) for every j in [first[i], until[i]), some PIECE pairs at a time."""
    count = np.maximum(until - first, 0)
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + 4 * PIECE, "right")))
        n = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, np.repeat(first[lo:hi], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def _sized(t: dict) -> np.ndarray:
    """Members in one line: runs one after the other, sizes rising in each."""
    run = np.cumsum(np.r_[0, t["token"][1:] != t["token"][:-1]])
    return run.astype(np.int64) << 32


def _tries(t: dict, i: np.ndarray, j: np.ndarray, percent: int, best: bool = False) -> pa.RecordBatch:
    """Pairs of different components whose sketches allow the index; with
    ``best`` only the likeliest for each member and other component."""
    apart = t["comp"][i] != t["comp"][j]
    i, j = i[apart], j[apart]
    gap = np.abs(t["sketch"][i].astype(np.int16) - t["sketch"][j]).sum(axis=1, dtype=np.int64)
    total = t["n"][i].astype(np.int64) + t["n"][j]
    ok = np.flatnonzero(_allowed(gap, total, percent))
    if best and len(ok):
        # the share of the two that may differ, in millionths
        share, a, b = gap[ok] * 1_000_000 // total[ok], i[ok], t["comp"][j[ok]]
        order = np.lexsort((share, b, a))
        a, b = a[order], b[order]
        ok = ok[order][np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]
    return _pairs(t["sid"][i[ok]], t["sid"][j[ok]])


def _allowed(gap: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    # 100 * both >= percent * (total - both), and gap <= total - 2 * both
    return (100 + percent) * gap <= (100 - percent) * total


def _hub_pairs(t: dict, salt: int, percent: int):
    """A hub for each run and class of sizes, with all members that fit it."""
    line, n = _sized(t), t["n"].astype(np.int64)
    size_class = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
    mixed = mix64(t["sid"].view(np.uint64) ^ mix64(t["token"].view(np.uint64) + np.uint64(salt)))
    order = np.lexsort((mixed, size_class, line))
    new = np.r_[True, (line[order][1:] != line[order][:-1]) | (size_class[order][1:] != size_class[order][:-1])]
    hub = order[new]
    place = line + n
    first = np.searchsorted(place, line[hub] - (-percent * n[hub] // 100), "left")
    until = np.searchsorted(place, line[hub] + 100 * n[hub] // percent, "right")
    for i, j in _partners(first, until):
        yield _tries(t, hub[i], j, percent)


def _cross_pairs(t: dict, percent: int, best: bool = False):
    """All members of a run that fit and lie in different components: those
    outside the run's main component with the members behind them, and with
    those of the main component ahead of them."""
    line, n = _sized(t), t["n"].astype(np.int64)
    place = line + n
    order = np.lexsort((t["comp"], line))
    new = np.flatnonzero(np.r_[True, (line[order][1:] != line[order][:-1])
                               | (t["comp"][order][1:] != t["comp"][order][:-1])])
    count = np.diff(np.r_[new, len(n)])
    group = np.repeat(np.arange(len(new)), count)
    by_run = np.lexsort((count, line[order][new]))
    last = np.r_[line[order][new][by_run][1:] != line[order][new][by_run][:-1], True]
    is_main = np.zeros(len(n), bool)
    is_main[order] = np.isin(group, by_run[last])
    out, main = np.flatnonzero(~is_main), np.flatnonzero(is_main)
    until = np.searchsorted(place, line[out] + 100 * n[out] // percent, "right")
    for i, j in _partners(out + 1, until):
        yield _tries(t, out[i], j, percent, best)
    first = np.searchsorted(place[main], line[out] - (-percent * n[out] // 100), "left")
    for i, j in _partners(first, np.searchsorted(main, out)):
        yield _tries(t, out[i], main[j], percent, best)


def _piece_pairs(t: dict, percent: int):
    """Pairs of a piece outside the main component (``role`` 1) and a piece of
    all members (0)."""
    line, n = _sized(t), t["n"].astype(np.int64)
    out, rest = np.flatnonzero(t["role"] == 1), np.flatnonzero(t["role"] == 0)
    place = (line + n)[rest]
    first = np.searchsorted(place, line[out] - (-percent * n[out] // 100), "left")
    until = np.searchsorted(place, line[out] + 100 * n[out] // percent, "right")
    for i, j in _partners(first, until):
        i, j = out[i], rest[j]
        # two that are both outside meet twice
        once = (t["is_main"][j] == 1) | (t["sid"][i] < t["sid"][j])
        yield _tries(t, i[once], j[once], percent)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _placed(rows: DataFrame, components: DataFrame) -> DataFrame:
    return (rows.join(components.select(F.col("node").alias("sid"), "component"), "sid", "left")
            .withColumn("comp", F.coalesce("component", "sid")).drop("component"))


def candidate_pairs(rows: DataFrame, components: DataFrame, s: JoinSettings, salt: int | None,
                    best: bool = False) -> DataFrame:
    """Pairs to try: of hubs (with ``salt``) or all that are left, or of these
    the best of each member."""
    percent = s.percent

    def tries(batches):
        for t in _whole_runs(batches):
            yield from _hub_pairs(t, salt, percent) if salt is not None else _cross_pairs(t, percent, best)

    return _sorted_buckets(_placed(rows, components)).mapInArrow(tries, "a long, b long").distinct()


def long_tokens(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """Tokens of the runs of more than ``run_limit`` rows, and of some of half
    as many. ``rows`` are stored as ``shared_rows`` sorts them, so a run lies in
    one stretch or, at a split, two."""
    least = max(1, s.run_limit // 2)

    def scan(batches):
        last, length = None, 0
        for batch in batches:
            token = batch.column("token").to_numpy()
            if not len(token):
                continue
            new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[new, len(token)])
            first = token[new]
            if last is not None:
                if first[0] == last:
                    count[0] += length
                elif length >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64())], ["token"])
            last, length = first[-1], count[-1]
            yield pa.RecordBatch.from_arrays([pa.array(first[:-1][count[:-1] >= least])], ["token"])
        if last is not None and length >= least:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64())], ["token"])

    return rows.select("token").mapInArrow(scan, "token long").distinct()


def run_shares(rows: DataFrame) -> DataFrame:
    """Per token: its main component, members, and members outside it."""
    per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"),
                                    (F.sum("c") - F.max("c")).alias("outside"))


def long_hub_pairs(rows: DataFrame, shares: DataFrame, s: JoinSettings, salt: int) -> DataFrame:
    """One hub for each token and class of sizes from outside the main
    component, and for each set the hub that is most like it."""
    percent = s.percent
    rows = rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent))))
    hubs = (rows.join(F.broadcast(shares), "token").filter("comp != main or outside = 0").groupBy("token", "class")
            .agg(F.min_by(F.struct("sid", "n", "comp", "sketch"), F.xxhash64("sid", F.lit(salt))).alias("h"))
            .select("token", F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class"),
                    *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("sid", "n", "comp", "sketch")))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTED - 1)))))
    wide = (rows.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(SALTED)).cast("int"))
            .join(hubs.hint("merge"), ["token", "class", "part"]).filter("comp != h_comp")
            .select("sid", "n", "sketch", "h_sid", "h_n", "h_sketch"))

    def tries(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                t = {c: _values(batch.slice(lo, PIECE).column(c)) for c in batch.schema.names}
                gap = np.abs(t["sketch"].astype(np.int16) - t["h_sketch"]).sum(axis=1, dtype=np.int64)
                ok = _allowed(gap, t["n"].astype(np.int64) + t["h_n"], percent)
                yield pa.RecordBatch.from_arrays([pa.array(t["sid"][ok]), pa.array(t["h_sid"][ok]),
                                                  pa.array(gap[ok])], ["sid", "hub", "gap"])

    best = (wide.mapInArrow(tries, "sid long, hub long, gap long").groupBy("sid")
            .agg(F.min_by("hub", F.struct("gap", "hub")).alias("hub")))
    return best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()


def long_pieces(rows: DataFrame, shares: DataFrame, s: JoinSettings) -> DataFrame:
    """Rows of long runs by tasks (``token`` is a hash of token and pieces):
    a piece of what lies outside the main component, and a piece of all."""
    parts = lambda c: F.ceil(F.col(c) / F.lit(s.run_limit)).cast("int")
    each = lambda p: F.explode(F.sequence(F.lit(0), p - 1))
    own = lambda p: F.pmod(F.xxhash64("sid"), p).cast("int")
    rows = (rows.join(F.broadcast(shares.filter("outside > 0")), "token")
            .withColumn("is_main", (F.col("comp") == F.col("main")).cast("int")))
    whole = rows.withColumn("i", each(parts("outside"))).withColumn("j", own(parts("all"))).withColumn("role", F.lit(0))
    outer = (rows.filter("is_main = 0").withColumn("i", own(parts("outside"))).withColumn("j", each(parts("all")))
             .withColumn("role", F.lit(1)))
    return whole.unionByName(outer).select(F.xxhash64("token", "i", "j").alias("token"), "sid", "n", "sketch", "comp",
                                           "is_main", "role")


def long_cross_pairs(rows: DataFrame, shares: DataFrame, s: JoinSettings) -> DataFrame:
    percent = s.percent

    def tries(batches):
        for t in _whole_runs(batches):
            yield from _piece_pairs(t, percent)

    return _sorted_buckets(long_pieces(rows, shares, s)).mapInArrow(tries, "a long, b long").distinct()


def _whole_runs(batches):
    """Runs of equal tokens, many at a time; a member has about 300 bytes, and
    a run ``run_limit`` or, of two pieces, about twice as many members."""
    held = None
    for batch in batches:
        t = {c: _values(batch.column(c)) for c in batch.schema.names}
        if held is not None:
            t = {c: np.concatenate([held[c], t[c]]) for c in t}
        if not len(t["token"]):
            continue
        cut = int(np.searchsorted(t["token"], t["token"][-1], "left"))
        held = {c: v[cut:] for c, v in t.items()}
        if cut:
            yield {c: v[:cut] for c, v in t.items()}
    if held is not None and len(held["token"]):
        yield held


def _likely(pairs: DataFrame, feats: DataFrame, s: JoinSettings, column: str) -> DataFrame:
    """Pairs that the sketches in ``column`` allow too. Pairs of which one has
    no finer sketch were judged by the same parts within the bucket."""
    percent = s.percent
    large = feats.filter(F.col(column).isNotNull())
    of = lambda x: large.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"f_{x}"))
    wide = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "f_a", "f_b")

    def test(batches):
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            gaps = np.fromiter((fine_gap(plain(x.as_py()), plain(y.as_py())) for x, y in
                                zip(batch.column("f_a"), batch.column("f_b"))), np.int64, batch.num_rows)
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(~_allowed(gaps, total, percent)))

    return pairs.join(wide.mapInArrow(test, "a long, b long"), ["a", "b"], "left_anti")


def _whole_sets(docs: DataFrame, owners: DataFrame, pairs: DataFrame, s: JoinSettings) -> DataFrame:
    """(sid, tokens) of the sets in ``pairs``, each from one document."""
    needed = Stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(owners, "sid"),
                    "join-needed").read()
    # a short list goes to the documents; a long one meets them in a shuffle
    if needed.count() <= s.broadcast_ids:
        needed = F.broadcast(needed)
    k = s.k

    def tokens(batches):
        for part in text_slices(batches):
            rows = [(i, t.tobytes()) for i, t in zip(part.column("sid").to_pylist(),
                                                     shingle_sets(part.column("text"), k)) if set_id(t) == i]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()),
                                              pa.array([t for _, t in rows], pa.binary())], ["sid", "tokens"])

    return docs.join(needed, "doc_id").select("sid", "text").mapInArrow(tokens, "sid long, tokens binary")


def _links(pairs: DataFrame, sets: DataFrame, s: JoinSettings, common) -> DataFrame:
    """The pairs that share a prefix token under both orders, and then have
    an index of at least ``percent``."""
    percent = s.percent
    of = lambda side: sets.select(F.col("sid").alias(side), F.col("tokens").alias(f"tokens_{side}"))
    wide = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "tokens_a", "tokens_b")

    def verify(batches):
        table = common.value
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok = all(len(np.intersect1d(prefix(x, percent, z, *table), prefix(y, percent, z, *table)))
                         for z in SALTS)
                if ok:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return wide.mapInArrow(verify, "a long, b long")


def _common_tokens(rows: DataFrame, s: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """At most ``common_tokens`` tokens, sorted, and how common each is."""
    top = (rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= s.common_from)
           .orderBy(F.col("df").desc(), "token").limit(s.common_tokens).toArrow())
    token = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["df"].to_numpy().astype(np.int64)[order]


def set_components(docs: DataFrame, s: JoinSettings = JoinSettings(), id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, print, sid, n; sets that have links: node,
    component), both stored; ``print`` is a hash of the text. Components are exact; links within one are not all listed."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("doc_id"),
                       F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    own = Stored(members(docs, s), "join-members")
    owners = (own.read().filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    prefixes = own.read().select(F.explode("first").alias("token"))
    common = spark.sparkContext.broadcast(_common_tokens(prefixes, s))
    feats = Stored(features(docs, s, common), "join-features")
    one = feats.read().select(F.explode("first1").alias("token"), "sid", "n")
    passed = Stored(shared_rows(one, s).select("sid").distinct(), "join-passed")
    two = (feats.read().join(passed.read().hint("merge"), "sid", "left_semi")      # the same plan at every size
           .select(F.explode("first2").alias("token"), "sid", "n"))
    # sketches are for the rows that are left
    bare = Stored(shared_rows(two, s), "join-bare")
    rows = Stored(bare.read().join(feats.read().select("sid", "sketch"), "sid")
                  .select("token", "sid", "n", "sketch"), "join-rows")
    tokens = Stored(long_tokens(bare.read(), s), "join-long-tokens")
    bare.drop()
    passed.drop()
    light, long = rows.read(), None
    if tokens.read().limit(1).count():
        heavy = F.broadcast(tokens.read())      # one in run_limit / 2 rows at most
        light, long = light.join(heavy, "token", "left_anti"), light.join(heavy, "token", "left_semi")
    none = spark.createDataFrame([], "node long, component long")
    links, found = spark.createDataFrame([], "a long, b long"), none

    sizes = feats.read().select("sid", "n")
    at_once = max(LEAST_VERIFIED, (sizes.agg(F.sum("n")).first()[0] or 0) // 2)

    def join(listed: DataFrame):
        """Test the pairs; their links join components. Whole sets travel with
        each pair, so many pairs are verified in turns that need no more disk
        than the sets themselves would."""
        nonlocal links, found
        tries = Stored(listed, "join-tries")
        allowed = Stored(_likely(tries.read(), feats.read(), s, "fine"), "join-allowed")
        pairs = Stored(_likely(allowed.read(), feats.read(), s, "dense"), "join-pairs")
        sets = Stored(_whole_sets(docs, owners, pairs.read(), s), "join-sets")
        moved = pairs.read().join(sizes.withColumnRenamed("sid", "a"), "a").agg(F.sum("n")).first()[0] or 0
        turns, new = max(1, -(-moved // at_once)), none.toDF("a", "b")
        for turn in range(turns):
            of = F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn
            new = new.unionByName(Stored(_links(pairs.read().filter(of), sets.read(), s, common), "join-links").read())
            free_shuffles(spark)
        for done in (tries, allowed, pairs, sets):
            done.drop()
        if new.limit(1).count():
            links = links.unionByName(new)
            found = connected_components(links).read()

    def placed_long() -> tuple[DataFrame, DataFrame, int]:
        rows = _placed(long, found)
        shares = Stored(run_shares(rows), "join-shares").read()
        return rows, shares, shares.agg(F.sum("outside")).first()[0] or 0

    if long is not None:
        left, salt = None, 0
        while True:
            own_rows, shares, outside = placed_long()
            # rounds go on as long as they halve what is left
            if not outside or left is not None and 2 * outside > left:
                break
            left, salt = outside, salt + 1
            join(long_hub_pairs(own_rows, shares, s, salt))
    for salt in range(1, s.hub_rounds + 1):
        join(candidate_pairs(light, found, s, salt))
    for _ in range(s.best_rounds):
        join(candidate_pairs(light, found, s, None, best=True))
    last = candidate_pairs(light, found, s, None)
    if long is not None:
        own_rows, shares, _ = placed_long()
        last = last.unionByName(long_cross_pairs(own_rows, shares, s)).distinct()
    join(last)
    rows.drop()
    feats.drop()
    return own.read().drop("first"), found


def similar_documents(docs: DataFrame, s: JoinSettings = JoinSettings(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest
    id that links reach, itself included)."""
    own, found = set_components(docs, s, id_col, text_col)
    placed = (own.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left")
              .withColumn("component", F.coalesce("component", "sid")))
    least = (placed.filter("sid is not null").groupBy("component").agg(F.min("doc_id").alias("least")))
    real = lambda c: F.when(c != F.lit(NULL_ID), c)
    return placed.join(least, "component", "left").select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        real(F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, s: JoinSettings = JoinSettings(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component
    stays, that of the smallest id (a null is the smallest; of equal ids, that
    of the smaller hash of the text). Rows without words are linked with
    nothing and all stay; ids say nothing otherwise, so rows with equal or
    null ids and different texts stay too. All columns are kept."""
    own, found = set_components(docs, s, id_col, text_col)
    placed = (own.filter("sid is not null").join(found.select(F.col("node").alias("sid"), "component"), "sid", "left")
              .select("doc_id", "print", F.coalesce("component", "sid").alias("component")))
    copies = placed.groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("stays"), F.count(F.lit(1)).alias("c"))
    judged = placed.join(copies.filter("c > 1"), "component").withColumn("goes", F.struct("doc_id", "print") != F.col("stays"))
    # those that go, and those of which several equal rows would stay, are far fewer than the others
    few = Stored(judged.groupBy("doc_id", "print").agg(F.max("goes").alias("goes"), F.count(F.lit(1)).alias("c"))
                 .filter("goes or c > 1").select(F.col("doc_id").alias(_free(docs, "id")), F.col("print").alias(_free(docs, "print")),
                                                 F.col("goes").alias(_free(docs, "goes"))), "join-few").read()
    key, mark, goes = few.columns
    rows = docs.withColumns({key: F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long"), mark: F.xxhash64(text_col)})
    kept = rows.join(few, [key, mark], "left_anti")
    twice = few.filter(~F.col(goes)).drop(goes)
    if not twice.isEmpty():
        kept = kept.unionByName(rows.join(twice, [key, mark], "left_semi").dropDuplicates([key, mark]))
    return kept.select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def brute_force(rows: list[tuple[int, str | None]], k: int = 4, percent: int = 85) -> list[tuple]:
    """What ``similar_documents`` must give, for tests (unique ids)."""
    import re
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k
                    else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]
