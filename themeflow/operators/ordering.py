"""Global order positions without a single-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
For frames whose size grows with the data we range-partition on the order
keys, number rows inside each partition, and add the sizes of all earlier
partitions (a frame with one row per partition, so its size is bounded by the
partition count, not by the data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeflow.session import materialize

_PID, _MID = "__pid", "__mid"


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    # without an explicit count AQE may merge small ranges; partition ids are
    # read after the shuffle and stored with the rows, so any count works
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    sorted_df = ranged.sortWithinPartitions(*order)
    local = (sorted_df
             .withColumn(_PID, F.spark_partition_id())
             .withColumn(_MID, F.monotonically_increasing_id()))
    # Materialise once: the partition numbers and local positions must be the
    # same in both uses below, also after an executor loss.
    return materialize(local, "ranged")


def _offsets(local: DataFrame, value: Column, name: str) -> DataFrame:
    per_part = local.groupBy(_PID).agg(F.sum(value).alias("__part_total"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(_PID, F.coalesce(F.sum("__part_total").over(w), F.lit(0)).alias(name))


def with_row_index(df: DataFrame, order: list[Column], name: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (which must be total)."""
    local = _ranged(df, order, partitions)
    local_pos = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    offsets = _offsets(local, F.lit(1), "__offset")
    out = local.join(F.broadcast(offsets), _PID, "left")
    return out.withColumn(name, F.col("__offset") + local_pos + 1).drop(_PID, _MID, "__offset")


def with_running_sum(df: DataFrame, value: str, order: list[Column], name: str,
                     index_name: str | None = None, partitions: int | None = None) -> DataFrame:
    """Running total of ``value`` in ``order`` (rows up to and including the
    current one), optionally with the 1-based position as well."""
    local = _ranged(df, order, partitions)
    w = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    local = local.withColumn("__local_sum", F.sum(value).over(w))
    offsets = _offsets(local, F.col(value), "__offset")
    out = local.join(F.broadcast(offsets), _PID, "left")
    out = out.withColumn(name, F.col("__offset") + F.col("__local_sum"))
    if index_name:
        counts = _offsets(local, F.lit(1), "__ioffset")
        out = (out.join(F.broadcast(counts), _PID, "left")
               .withColumn(index_name, F.col("__ioffset") + F.col(_MID)
                           - F.shiftleft(F.col(_PID).cast("long"), 33) + 1)
               .drop("__ioffset"))
    return out.drop(_PID, _MID, "__offset", "__local_sum")
