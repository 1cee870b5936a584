"""Intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from themeflow.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it learns
    of them from the driver's garbage collection, which else may not come for
    half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: With this setting Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """A frame written as Parquet once and read from there ever after.

    Written tables survive lost executors and end the lineage. ``drop``
    deletes a table that nothing reads any more. With ``free`` the write's
    shuffle files go when it ends, not when the driver collects its garbage
    and finds that nothing holds the frame."""

    def __init__(self, df: DataFrame, name: str, free: bool = False):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, name)
        before = self.spark.conf.get(_CLEANUP, "false")
        if free:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            if free:
                self.spark.conf.set(_CLEANUP, before)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        free_shuffles(self.spark)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, where the caller need not drop it."""
    return Stored(df, name).read()
