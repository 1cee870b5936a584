"""Whitening of embeddings by the exact characteristic polynomial.

Entries become integers, so counts, sums and the scatter matrix are exact. The
scatter's characteristic polynomial comes from Hessenberg forms modulo many
primes (one Spark row per prime) and Chinese remaindering; the largest roots
are isolated by exact sign counts, and inverse iteration gives the components
(one Spark row per component). The driver holds one dims x dims matrix and the
polynomial, whatever the number of vectors.

Results for odd input: vectors that are null, empty, or hold an entry that is
null, not finite or too large for the integers are dropped. Vectors of several
lengths: those of the most frequent length count (of equally many, the
longest), the others lack entries and are dropped. Repeated rows and null ids
count like any others. Components with no variance are not returned, so a
single vector, or equal ones, give no row, and so does an empty table. Other
columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm import charpoly
from themeflow.llm.stored import Stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_LIMB = 40  # bits of the parts in which Spark sums large integers
_EXACT = float(1 << 53)


def _integer_rows(batch: pa.RecordBatch, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) by length of vector: which rows of the batch have whole
    vectors, and their entries as integers."""
    lists = batch.column("v")
    lists = lists.take(pa.array(np.arange(len(lists))))  # own offsets
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    for size in np.unique(sizes[sizes > 0]) if dims is None else [dims]:
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        whole = (np.abs(x) < _EXACT / SCALE).all(axis=1)  # not so for NaN and infinity
        yield rows[whole], np.floor(SCALE * x[whole]).astype(np.int64) + SHIFT


def _limbs(value: int) -> tuple[int, int, int]:
    mask = (1 << _LIMB) - 1
    return value & mask, value >> _LIMB & mask, value >> 2 * _LIMB


class _Moments:
    """Count, sums and scatter of integer vectors around a point of their own, exact."""

    def __init__(self, x: np.ndarray):
        self.at = np.rint(x.mean(axis=0)).astype(np.int64)
        self.n, self.s = 0, np.zeros(x.shape[1], object)
        self.g = np.zeros((x.shape[1],) * 2, object)

    def add(self, x: np.ndarray) -> None:
        y = x - self.at  # centred before it is multiplied
        self.n += len(y)
        self.s += y.sum(axis=0).astype(object)
        if len(y) * float(np.abs(y).max(initial=0)) ** 2 < _EXACT:  # doubles hold every partial sum
            f = y.astype(float)
            self.g += (f.T @ f).astype(np.int64).astype(object)
        else:
            o = y.astype(object)
            self.g += o.T @ o

    def rows(self) -> Iterator[tuple]:
        """(dims, i, j, limbs) of the count (-1, -1), the sums (i, -1) and the
        scatter around zero."""
        d, at = len(self.s), self.at.astype(object)
        total = self.s + self.n * at
        around = self.g + np.outer(at, total) + np.outer(total, at) - self.n * np.outer(at, at)
        yield (d, -1, -1, *_limbs(self.n))
        for i in range(d):
            yield (d, i, -1, *_limbs(int(total[i])))
            for j in range(i, d):
                yield (d, i, j, *_limbs(int(around[i, j])))


_PARTS = "dims int, i int, j int, l0 long, l1 long, l2 long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moments: dict[int, _Moments] = {}
    for batch in batches:
        for _, x in _integer_rows(batch):
            if len(x):
                moments.setdefault(x.shape[1], _Moments(x)).add(x)
    kinds = [pa.int32()] * 3 + [pa.int64()] * 3
    for m in moments.values():
        columns = zip(*m.rows())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         [f.split()[0] for f in _PARTS.split(", ")])


@dataclass
class Whitener:
    """``sums``: exact sums of ``n`` vectors of integers; ``trace``: of the
    covariance; ``vectors``: unit rows, by falling ``values``."""

    n: int
    sums: list[int]
    trace: float
    values: list[float]
    vectors: list[list[float]]


def _scatter(df: DataFrame) -> tuple[int, list[int], list[list[int]]] | None:
    """(n, sums, n * scatter around the mean) of the chosen length, or None."""
    parts = Stored(df.mapInArrow(_parts, _PARTS).groupBy("dims", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("l0", "l1", "l2")]), "whiten-sums")
    count = F.col("l0") + F.col("l1") * (1 << _LIMB)
    chosen = parts.read().filter("i = -1").orderBy(count.desc(), F.col("dims").desc()).first()
    if chosen is None:
        parts.drop()
        return None
    d = chosen["dims"]
    sums, gram, n = [0] * d, [[0] * d for _ in range(d)], 0
    for r in parts.read().filter(F.col("dims") == d).toLocalIterator():  # d (d + 3) / 2 + 1 rows
        value = r["l0"] + (r["l1"] << _LIMB) + (r["l2"] << 2 * _LIMB)
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            sums[r["i"]] = value
        else:
            gram[r["i"]][r["j"]] = gram[r["j"]][r["i"]] = value
    parts.drop()
    return n, sums, [[n * gram[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def _polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Each prime is a row; what comes back is one residue per coefficient."""
    primes = charpoly.moduli(matrix)

    def residues(batches):
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([charpoly.polynomial_mod(matrix, p)])], ["p", "c"])

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(
        residues, "p long, c array<long>").collect()
    return charpoly.combine([(r["p"], r["c"]) for r in rows])


def fit_whitener(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The largest components of the vectors' integers; None without vectors."""
    spark = vectors.sparkSession
    found = _scatter(vectors.select(F.col(vector).alias("v")))
    if found is None:
        return None
    n, sums, matrix = found  # n ** 2 times the covariance
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return Whitener(n, sums, 0.0, [], [])
    poly = _polynomial(spark, matrix)
    many = min(components, charpoly.positive_roots(poly))

    def solve(batches):
        for batch in batches:
            for nth in batch.column("id").to_pylist():
                low, shift, first, last = charpoly.root_bracket(poly, trace, nth + 1)
                vector = charpoly.null_vectors(matrix, low, shift, last - first + 1)[nth + 1 - first]
                value = (2 * low + 1) / (n * n << shift + 1)  # a quotient of integers, rounded once
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nth], pa.int64()), pa.array([value]), pa.array([vector])], ["nth", "value", "vector"])

    rows = spark.range(many).repartition(many).mapInArrow(
        solve, "nth long, value double, vector array<double>").collect() if many else []
    rows.sort(key=lambda r: r["nth"])
    return Whitener(n, sums, trace / (n * n), [r["value"] for r in rows], [list(r["vector"]) for r in rows])


def _deviations(x: np.ndarray, fit: Whitener) -> pa.Array:
    """Sums of squares of n x - S, exact."""
    kind = pa.decimal128(38, 0)
    most = max((abs(fit.n * int(x[:, i].max()) - s) + fit.n * int(np.ptp(x[:, i])) for i, s in enumerate(fit.sums)), default=0) if len(x) else 0
    if most * most * len(fit.sums) < 1 << 62 and fit.n * int(np.abs(x).max(initial=0)) < 1 << 62:
        y = fit.n * x - np.array(fit.sums, np.int64)
        return pa.array((y * y).sum(axis=1)).cast(kind)
    y = fit.n * x.astype(object) - np.array(fit.sums, object)
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (y * y).sum(axis=1).tolist()], kind)


def apply_whitener(vectors: DataFrame, fit: Whitener, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, deviation decimal, whitened array) of each whole vector. A
    deviation of more than 38 digits is null."""
    whole = [s // fit.n for s in fit.sums]
    rest = np.array([s % fit.n / fit.n for s in fit.sums])
    matrix = np.array(fit.vectors).reshape(len(fit.vectors), len(fit.sums)).T / np.sqrt(np.array(fit.values))

    def project(batches):
        for batch in batches:
            ((rows, x),) = _integer_rows(batch, len(fit.sums))
            w = ((x - np.array(whole, np.int64)) - rest) @ matrix
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), _deviations(x, fit), lists],
                                             ["id", "deviation", "whitened"])

    kind = vectors.schema[id_column].dataType.simpleString()
    df = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    out = df.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id_column)


def whiten(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: (id, component, n, deviation
    long, whitened, explained, identity_error, deviation_exact decimal). A
    deviation too large for a long is null there."""
    spark = vectors.sparkSession
    fit = fit_whitener(vectors, vector, components)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = (f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    if fit is None or not fit.values:
        return spark.createDataFrame([], schema)
    wide = Stored(apply_whitener(vectors, fit, vector, id_column), "whitened").read()
    k = len(fit.values)
    entries = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j))
               for i in range(k) for j in range(i, k)]
    error = wide.select(F.greatest(*entries, F.lit(0.0))).first()[0]
    explained = F.array(*[F.lit(v / fit.trace) for v in fit.values])
    return wide.select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_column, (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"))
