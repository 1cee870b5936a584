"""Vector expressions on ``array<float|double>`` columns (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def dot(a, b) -> Column:
    """Dot product; with unit vectors this is the cosine similarity."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def with_unit_vectors(df: DataFrame, col: str = "embedding", out: str = "unit") -> DataFrame:
    """L2-normalise each vector (as double); a zero vector stays zero.
    The norm is its own column so the division does not recompute it per
    element."""
    staged = df.withColumn("__norm", norm(col))
    staged = staged.withColumn("__norm", F.when(F.col("__norm") == 0, F.lit(1.0)).otherwise(F.col("__norm")))
    return staged.withColumn(out, F.transform(as_double(col), lambda x: x / F.col("__norm"))).drop("__norm")
