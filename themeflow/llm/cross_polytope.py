"""Near duplicates among embeddings by cross-polytope hashing.

A unit vector is turned by fast Hadamard transforms between random signs; its
hash is the nearest of the 2 D signed axes, for ``width`` turns together. Each
of ``tables`` tables takes the ``probes`` best hashes of a vector (multiprobe
on both sides), and vectors of one label that share a bucket are compared.

Buckets compare sketches of a byte per entry, whose error is bounded: pairs
above the bound are links, pairs within the error are decided on the vectors.
A pair counts in the first bucket that it shares, so counts need no list of
pairs. Three things keep groups of copies from growing quadratic: equal
vectors are one; vectors within half the angle of a common centre are a ball,
all of them linked to one another without a comparison; buckets above
``run_limit`` are dealt out in pieces, and pieces of one ball never meet.

Results for odd input: vectors that are null, empty, zero or hold null or
non-finite entries, and those without label, link with nothing. Vectors of
different lengths link with nothing of the other length. Rows are vectors of
their own, also if an id occurs twice; a component's id is the smallest that
is not null, a null if there is none. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeflow.functions.vectors import dot, norm
from themeflow.llm.components import connected_components
from themeflow.llm.stored import Stored

#: (probes, tables) by width: each finds 99 % of the pairs at a cosine of 0.93.
_PLANS = {1: (2, 3), 2: (4, 4), 3: (8, 5)}
#: Vectors of a label that a bucket should hold, on average.
_BUCKET = 512
_NO_BALL = -1
_KEY = ["label", "dims", "tab", "code"]


@dataclass(frozen=True)
class NearSettings:
    """``width``: turns per hash; None picks it by the largest label, so that
    buckets keep their size. ``run_limit``: vectors that a task compares at once."""

    cosine: float = 0.93
    width: int | None = None
    run_limit: int = 1024
    seed: int = 13


# ------------------------------------------------------------------- hashing

def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long)."""
    rows, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, d)
        half *= 2
    return x / np.sqrt(d)


def _axes(x: np.ndarray, signs: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` nearest signed axes of each turned row, and how much
    farther than the nearest each is."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    best = np.argsort(-size, axis=1, kind="stable")[:, :many]
    near = np.take_along_axis(size, best, 1)
    return 2 * best + (np.take_along_axis(x, best, 1) < 0), near[:, :1] - near


def bucket_codes(unit: np.ndarray, width: int, probes: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) codes, the vector's own bucket first."""
    d = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d))
    x[:, :unit.shape[1]] = unit
    out = np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        code, far = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for turn in range(width):
            signs = np.random.default_rng([seed, t, turn]).choice([-1.0, 1.0], (3, d))
            axis, more = _axes(x, signs, min(probes, d))
            code = (code[:, :, None] * (2 * d) + axis[:, None, :]).reshape(len(unit), -1)
            far = (far[:, :, None] + more[:, None, :]).reshape(len(unit), -1)
            keep = np.argsort(far, axis=1, kind="stable")[:, :probes]
            code, far = np.take_along_axis(code, keep, 1), np.take_along_axis(far, keep, 1)
        out[:, t, :code.shape[1]] = code
        out[:, t, code.shape[1]:] = code[:, :1]  # short vectors have fewer buckets
    return out


def sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte per entry, the scale of each row, and a bound of the length of what is lost."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-9
    return q, scale, lost


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.take(pa.array(np.arange(len(lists)))).flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest of the vector's entries; null where nothing can be linked."""
    for batch in batches:
        prints = []
        for vector, label in zip(batch.column("vec"), batch.column("label")):
            whole = vector.is_valid and label.is_valid and len(vector.values) and not vector.values.null_count
            values = vector.values.to_numpy(zero_copy_only=False) + 0.0 if whole else None  # no negative zeros
            linked = whole and np.isfinite(values).all() and values.any()
            prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if linked else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], [*batch.schema.names, "print"])


def _hashed(width: int, seed: int):
    probes, tables = _PLANS[width]

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                unit = _unit(_matrix(rows.column("vec")))
                codes = bucket_codes(unit, width, probes, tables, seed)
                q, scale, lost = sketch(unit)
                lists = [pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * m.shape[1], m.ravel())
                         for m in (unit, codes.reshape(len(unit), -1))]
                extra = [*lists, pa.array([c.tobytes() for c in codes], pa.binary()),
                         pa.array([v.tobytes() for v in q], pa.binary()), pa.array(scale), pa.array(lost)]
                rows = rows.drop_columns(["vec"])
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [
                    *rows.schema.names, "unit", "codes", "packed", "sketch", "scale", "lost"])
    return run


# --------------------------------------------------------------------- balls

def _balls(reps: DataFrame, width: int, s: NearSettings) -> DataFrame:
    """(rep, ball): vectors within half the angle of a bucket's centre, by the
    smallest of them. Full buckets only; each table's in turn, for those still
    without. The centre is the mean of what is near the bucket's first vector."""
    probes, tables = _PLANS[width]
    half = float(np.cos(np.arccos(s.cosine) / 2)) + 1e-9
    found = reps.select("rep", F.col("rep").alias("ball")).limit(0)
    for t in range(tables):
        own = reps.join(found, "rep", "left_anti").select(
            "rep", "label", "dims", "unit", F.col("codes")[t * probes].alias("code"))
        key = ["label", "dims", "code"]
        full = own.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("unit", "rep").alias("first"))
        full = Stored(full.filter(F.col("n") > s.run_limit // 4), "near-full")
        if full.read().isEmpty():
            return found
        near = own.join(full.read().drop("n"), key).filter(dot("unit", "first") >= s.cosine)
        near = near.select(*key, array_to_vector("unit").alias("u"))
        centre = near.groupBy(*key).agg(Summarizer.mean(F.col("u")).alias("u")).select(*key, vector_to_array("u").alias("centre"))
        inside = Stored(own.join(centre, key).filter(dot("unit", "centre") >= F.lit(half) * norm("centre")).select("rep", *key), "near-inside")
        names = inside.read().groupBy(*key).agg(F.min("rep").alias("ball"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        more = inside.read().join(names.drop("n"), key).select("rep", "ball")
        found = Stored(found.unionByName(more), "near-balls").read()
        full.drop()
        inside.drop()
    return found


# ------------------------------------------------------------------- buckets

def _bucket_rows(reps: DataFrame, probes: int, run_limit: int) -> DataFrame:
    """A row per vector and bucket, and per pair of pieces where a bucket has
    more than ``run_limit``: (key, lo, hi, piece, ...)."""
    rows = reps.select("rep", "label", "dims", "mult", "ball", "packed", "sketch", "scale", "lost",
                       F.posexplode(F.array_distinct(F.zip_with(
                           F.sequence(F.lit(0), F.size("codes") - 1), "codes",
                           lambda i, c: F.struct(F.floor(i / probes).cast("int").alias("tab"), c.alias("code"))))).alias("at", "b"))
    rows = rows.select("*", "b.tab", "b.code").drop("at", "b")
    counts = Stored(rows.groupBy(*_KEY, "ball").agg(F.count(F.lit(1)).alias("n")), "near-counts").read()
    full = counts.groupBy(*_KEY).agg(F.sum("n").alias("all")).filter(F.col("all") > run_limit)
    kind = F.when((F.col("ball") != _NO_BALL) & (F.col("n") > run_limit), F.col("ball")).otherwise(_NO_BALL)
    deal = (counts.join(full, _KEY).groupBy(*_KEY, kind.alias("kind")).agg(F.sum("n").alias("n"))
            .withColumn("pieces", F.ceil(F.col("n") / run_limit).cast("int")))
    by_key = Window.partitionBy(*_KEY)
    deal = deal.select(*_KEY, "kind", "pieces", F.sum("pieces").over(by_key).cast("int").alias("total"),
                       (F.sum("pieces").over(by_key.orderBy("kind")) - F.col("pieces")).cast("int").alias("from"))
    deal = Stored(deal, "near-deal").read()
    how = F.struct("from", "pieces", "total")
    of_ball = deal.filter(F.col("kind") != _NO_BALL).select(*_KEY, F.col("kind").alias("ball"), how.alias("own"))
    mixed = deal.filter(F.col("kind") == _NO_BALL).select(*_KEY, how.alias("rest"))
    rows = rows.join(of_ball, [*_KEY, "ball"], "left").join(mixed, _KEY, "left")
    rows = rows.withColumn("d", F.coalesce("own", "rest"))
    piece = F.coalesce(F.col("d.from") + F.pmod(F.xxhash64("rep"), F.col("d.pieces")).cast("int"), F.lit(0))
    none = F.array().cast("array<int>")
    before = F.when(F.col("d.from") > 0, F.sequence(F.lit(0), F.col("d.from") - 1)).otherwise(none)
    end = F.col("d.from") + F.col("d.pieces")
    behind = F.when(end < F.col("d.total"), F.sequence(end, F.col("d.total") - 1)).otherwise(none)
    others = (F.when(F.col("d").isNull(), F.array(F.lit(0)))
              .when(F.col("own").isNotNull(), F.concat(before, behind))
              .otherwise(F.sequence(F.lit(0), F.col("d.total") - 1)))
    rows = rows.withColumn("piece", piece).withColumn("other", F.explode(others))
    return rows.withColumns({"lo": F.least("piece", "other"), "hi": F.greatest("piece", "other")}).drop("own", "rest", "d", "other")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, put together over batches; a run is bounded."""
    open_run: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key)
            cut |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        if open_run and any(open_run[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(open_run)
            open_run = []
        for lo, hi in zip(cuts, cuts[1:]):
            open_run.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(open_run)
                open_run = []
    if open_run:
        yield pa.Table.from_batches(open_run)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of ``n`` is connected to."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        root = root[root]
        if (root == old).all():
            return root


def _shared_first(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which pairs share no bucket before this one."""
    first = np.ones(len(i), bool)
    for t in range(table):
        first &= ~(codes[i, t, :, None] == codes[j, t, None, :]).any(axis=(1, 2))
    here = codes[i, table]
    common = (here[:, :, None] == codes[j, table][:, None, :]).any(axis=2)
    return first & (np.where(common, here, np.iinfo(np.int64).max).min(axis=1) == code)


_FOUND = "node long, other long, a long, b long, links long"


def _compared(s: NearSettings, width: int):
    """For each vector of a run with links: their number, and a vector of the
    run that it is connected to (with both classes); links -1: a pair to decide."""
    probes, tables = _PLANS[width]

    def run(batches):
        out: list[np.ndarray] = []
        for rows in _runs(batches, [*_KEY, "lo", "hi"]):
            if rows.num_rows > 1:
                out += compare(rows)
            if sum(o.shape[1] for o in out) > 50_000:
                yield record(out)
                out = []
        if out:
            yield record(out)

    def record(out):
        names = [f.split()[0] for f in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names)

    def compare(rows: pa.Table) -> list[np.ndarray]:
        number = lambda name: rows.column(name).to_numpy()
        raw = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        n = rows.num_rows
        ids, mult, ball, piece, scale, lost = map(number, ("rep", "mult", "ball", "piece", "scale", "lost"))
        q = raw("sketch", np.int8).reshape(n, -1).astype(np.float32)
        codes = raw("packed", np.int64).reshape(n, tables, probes)
        group = np.where(ball == _NO_BALL, ids, ball)
        table, code = rows.column("tab")[0].as_py(), rows.column("code")[0].as_py()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        ones, undecided = [], []
        for at in range(0, n, 512):
            part = slice(at, at + 512)
            close = (q[part] @ q.T).astype(float) * scale[part, None] * scale
            slack = lost[part, None] + lost + 2 * lost[part, None] * lost + 1e-6
            i, j = np.nonzero(close + slack >= s.cosine)
            sure = (close[i, j] - slack[i, j]) >= s.cosine
            i += at
            keep = (i < j) & (group[i] != group[j])
            if lo != hi:
                keep &= piece[i] != piece[j]
            i, j, sure = i[keep], j[keep], sure[keep]
            for cut in range(0, len(i), 1 << 16):
                x, y, z = (v[cut:cut + (1 << 16)] for v in (i, j, sure))
                first = _shared_first(codes, x, y, table, code)
                ones.append(np.stack([x[first & z], y[first & z]]))
                undecided.append(np.stack([x[first & ~z], y[first & ~z]]))
        if not ones:
            return []
        (i, j), (x, y) = np.concatenate(ones, axis=1), np.concatenate(undecided, axis=1)
        links = np.zeros(n, np.int64)
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        root, has = _roots(i, j, n), np.flatnonzero(links)
        return [np.stack([ids[has], ids[root[has]], group[has], group[root[has]], links[has]]),
                np.stack([ids[x], ids[y], group[x], group[y], np.full(len(x), -1)])]

    return run


# -------------------------------------------------------------------- result

def _width(vectors: DataFrame) -> int:
    """The smallest width whose buckets hold about ``_BUCKET`` vectors of the largest label."""
    top = vectors.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max("dims")).first()
    n, axes = top[0] or 0, 2 << (max(2, top[1] or 2) - 1).bit_length()
    return next((w for w in _PLANS if n * _PLANS[w][0] <= _BUCKET * axes ** w), max(_PLANS))


def near_duplicates(vectors: DataFrame, settings: NearSettings = NearSettings(), vector: str = "embedding",
                    label: str = "label", id_column: str = "vec_id") -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector."""
    s = settings
    df = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    printed = df.mapInArrow(_prints, f"{kinds}, print binary").withColumns(
        {"rid": F.monotonically_increasing_id(), "dims": F.size("vec")})
    stored = Stored(printed, "near-vectors").read()
    linkable = stored.filter(F.col("print").isNotNull())
    same = linkable.groupBy("label", "dims", "print").agg(
        F.min("rid").alias("rep"), F.count(F.lit(1)).alias("mult"), F.min("id").alias("first"))
    same = Stored(same, "near-same").read()
    width = s.width or _width(same)
    probes, _ = _PLANS[width]

    reps = same.join(linkable.select(F.col("rid").alias("rep"), "vec"), "rep").select(
        "rep", "label", "dims", "mult", "first", "vec")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.drop("vec").schema.fields)
    hashed = reps.mapInArrow(_hashed(width, s.seed), f"{kinds}, unit array<double>, codes array<long>, packed binary, "
                                                     "sketch binary, scale double, lost double")
    hashed = Stored(hashed, "near-hashed").read()
    balls = _balls(hashed, width, s)
    hashed = hashed.join(balls, "rep", "left").withColumn("ball", F.coalesce("ball", F.lit(_NO_BALL).cast("long")))
    rows = _bucket_rows(hashed, probes, s.run_limit)
    order = [*_KEY, "lo", "hi"]
    found = Stored(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared(s, width), _FOUND), "near-found").read()

    group = F.when(F.col("ball") == _NO_BALL, F.col("rep")).otherwise(F.col("ball"))
    classes = hashed.select("rep", "label", "dims", "mult", "first", group.alias("class"))
    sides = [hashed.select(F.col("rep").alias(k), F.col("unit").alias(f"v_{k}"), F.col("mult").alias(f"m_{k}")) for k in ("node", "other")]
    unsure = found.filter("links < 0").join(sides[0], "node").join(sides[1], "other")
    unsure = unsure.filter(dot("v_node", "v_other") >= s.cosine)
    decided = Stored(unsure.select("node", "other", "a", "b", F.inline(F.array(
        F.struct(F.col("node").alias("to"), F.col("m_other").alias("links")),
        F.struct(F.col("other").alias("to"), F.col("m_node").alias("links"))))), "near-decided").read()
    counted = found.filter("links > 0").select(F.col("node").alias("rep"), "links").unionByName(
        decided.select(F.col("to").alias("rep"), "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.filter("links > 0").select("a", "b").unionByName(decided.select("a", "b")).filter("a <> b")
    components = connected_components(edges).read().withColumnRenamed("node", "class")

    groups = classes.groupBy("class").agg(F.sum("mult").alias("size"), F.min("first").alias("first"))
    groups = Stored(groups.join(components, "class", "left").withColumn("component", F.coalesce("component", "class")),
                    "near-classes").read()
    names = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(names, "component").select("class", "size", "component_id")
    judged = classes.select("rep", "class").join(groups, "class").join(counted, "rep", "left").select(
        "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    judged = same.select("rep", "label", "dims", "print").join(judged, "rep").drop("rep")
    out = stored.select("id", "label", "dims", "print").join(
        judged.withColumn("judged", F.lit(True)), ["label", "dims", "print"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.when(F.col("judged"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_column)
