"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "themeflow",
                  shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A session with AQE on. On a cluster pass ``master=None`` and let the
    launcher decide, also on the number of shuffle partitions; a local session
    sizes shuffles to the core count. ``checkpoint_dir`` is the folder that
    driver and executors share; a cluster needs one."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    local = bool(master) and _is_local(master)
    if local:
        builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(master: str) -> bool:
    """Driver and executors are one process (not so for ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system, and it is an
    error if it is unset: executors would write where no other machine can
    read. Only a local session gets a folder of its own."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not _is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="themeflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


#: With this setting Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within delete their shuffle files when they end, not
    when the driver collects its garbage and finds that nothing holds them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read
    it back. Cuts lineage like ``checkpoint()``, computes the frame once,
    and the read-back frame has statistics from its real file size (a
    checkpointed frame keeps the estimates of its old plan, which in an
    iterative self-join grow without bound)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
