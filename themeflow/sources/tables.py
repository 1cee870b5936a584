"""Versioned parquet tables and workspaces.

Plain parquet has no UPDATE: every change writes the whole new table as a
new version directory ``<root>/v=<n>``; a version counts once Spark's commit
marker ``_SUCCESS`` is in it, and readers take the highest committed one. A
writer never overwrites the version it reads. A writer that may repeat itself
(a stream's batch) names its write: the name is part of the directory,
``v=<n>@<name>``, so it is committed with the version, whoever else writes.
Paths go through the Hadoop FileSystem of the session, so the same code runs
on HDFS or object stores.

``BucketedTable`` keeps rows in hash buckets of their key; a version is the
list of each bucket's folder, and a merge writes only the buckets it touches.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def workspace_name(name: str | None) -> str:
    """Workspace names keep letters, digits, ``_`` and ``-``; empty ->
    ``default``."""
    return re.sub(r"[^\w-]+", "", name or "") or "default"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def file_paths(spark: SparkSession, uris: list[str]) -> list[str]:
    """Paths to read for what ``_metadata.file_path`` names, which are URIs
    (a blank in a folder's name is ``%20`` there)."""
    jvm = spark.sparkContext._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(u)).toString() for u in uris]


#: Tasks that a bucket's rows are dealt over when they are written.
PARTS = 4


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _committed(self) -> dict[int, str | None]:
        """Version -> name of the write (None: unnamed)."""
        fs, p, jvm = _fs(self.spark, self.root)
        out = {}
        for st in fs.listStatus(p) if fs.exists(p) else []:
            m = re.fullmatch(r"v=(\d+)(?:@(.+))?", st.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out[int(m.group(1))] = m.group(2)
        return out

    def versions(self) -> list[int]:
        return sorted(self._committed())

    def latest(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def holds(self, name: str) -> bool:
        """Whether a write of this name is committed."""
        return name in self._committed().values()

    def path(self, version: int) -> str:
        name = self._committed().get(version)
        return self._path(version, name)

    def _path(self, version: int, name: str | None) -> str:
        return f"{self.root}/v={version}" + (f"@{name}" if name else "")

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"no committed version under {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(version))

    def write(self, df: DataFrame, version: int | None = None, name: str | None = None) -> int:
        """Write ``df`` as a new version (default: latest + 1). Writing an
        already committed version, or a committed ``name`` again, does
        nothing."""
        committed = self._committed()
        if name:
            for v, n in committed.items():
                if n == name:
                    return v
        if version is None:
            version = max(committed, default=-1) + 1
        if version in committed:
            return version
        df.write.mode("overwrite").parquet(self._path(version, name))
        return version

    def init(self, schema: T.StructType) -> int:
        """Create the table empty (also used to wipe it: a new empty version)."""
        return self.write(self.spark.createDataFrame([], schema))


    def merge(self, updates: DataFrame, keys: list[str], name: str | None = None, skip_existing: bool = False) -> int:
        """Insert or overwrite rows by key (one row per key in ``updates``);
        with ``skip_existing`` stored rows stay as they are."""
        if self.latest() is None:
            return self.write(updates.dropDuplicates(keys), name=name)
        return self.write(_merged(self.read(), updates, keys, skip_existing), name=name)


def _merged(base: DataFrame, updates: DataFrame, keys: list[str], skip_existing: bool) -> DataFrame:
    from themeflow.operators.state import upsert
    if skip_existing:  # the stored rows are the newer ones
        return upsert(updates.dropDuplicates(keys), base, keys).select(*base.columns)
    return upsert(base, updates, keys)


class BucketedTable(VersionedTable):
    """Versions of a keyed table that share the files of unchanged buckets.

    A version holds one row per bucket: its folder. ``merge`` finds the
    buckets of its rows, reads those alone, writes them to a new folder and
    commits a list in which the others keep theirs. ``buckets`` is fixed by
    the first version; take as many as make a bucket a file of usual size."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, root)
        self.keys, self._buckets = keys, buckets

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of its rows, in a version (default: the latest)."""
        return {r["bucket"]: r["folder"] for r in self._listed(version) if r["folder"]}

    def _listed(self, version: int | None = None) -> list:
        version = self.latest() if version is None else version
        return [] if version is None else self.spark.read.parquet(self.path(version)).collect()

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _open(self, folders: list[str], schema: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        listed = self._listed(version)
        if not listed:
            return super().read(version, schema)
        return self._open([r["folder"] for r in listed if r["folder"]], listed[0]["schema"])

    def touching(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the keys of ``rows`` fall into."""
        listed = self._listed()
        touched = self._touched(rows, listed[0]["buckets"])
        return self._open([r["folder"] for r in listed if r["folder"] and r["bucket"] in touched], listed[0]["schema"])

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(buckets)).distinct().collect()}

    def _dealt(self, df: DataFrame, buckets: int) -> DataFrame:
        """Rows by bucket, a large bucket in ``PARTS`` tasks by its keys."""
        h = F.xxhash64(*self.keys)
        return (df.withColumns({"__bucket": self._bucket(buckets), "__part": F.pmod(F.shiftright(h, 32), F.lit(PARTS)).cast("int")})
                .repartition("__bucket", "__part"))

    def _put(self, dealt: DataFrame) -> dict[int, str]:
        """Write dealt rows by bucket into a new folder. Their shuffle is as
        large as the table, so its files go at once."""
        from themeflow.session import shuffles_freed
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            dealt.drop("__part").write.option("compression", "zstd").partitionBy("__bucket").parquet(folder)
        fs, p, _ = _fs(self.spark, folder)
        return {int(st.getPath().getName().split("=")[1]): f"{folder}/{st.getPath().getName()}"
                for st in fs.listStatus(p) if st.isDirectory() and "=" in st.getPath().getName()}

    def _commit(self, folders: dict[int, str], schema: str, buckets: int, version: int | None, name: str | None) -> int:
        rows = [(b, f, schema, buckets) for b, f in folders.items()] or [(None, None, schema, buckets)]
        listed = self.spark.createDataFrame(rows, "bucket int, folder string, schema string, buckets int")
        return super().write(listed.coalesce(1), version, name)

    def write(self, df: DataFrame, version: int | None = None, name: str | None = None) -> int:
        """All rows anew (``df`` has the whole table)."""
        committed = self._committed()
        if version in committed:
            return version
        if name and self.holds(name):
            return next(v for v, n in committed.items() if n == name)
        listed = self._listed()
        buckets = listed[0]["buckets"] if listed else self._buckets
        return self._commit(self._put(self._dealt(df, buckets)), df.schema.json(), buckets, version, name)

    def merge(self, updates: DataFrame, keys: list[str] | None = None, name: str | None = None,
              skip_existing: bool = False) -> int:
        """Insert or overwrite rows by key; only buckets with such rows are
        written. ``updates`` is stored first, so it is computed once."""
        from themeflow.session import materialize, shuffles_freed
        if keys not in (None, self.keys):
            raise ValueError(f"the table's keys are {self.keys}")
        if name and self.holds(name):
            return next(v for v, n in self._committed().items() if n == name)
        listed = self._listed()
        if not listed:
            return self.write(updates.dropDuplicates(self.keys), name=name)
        schema, buckets, folders = listed[0]["schema"], listed[0]["buckets"], self.folders()
        with shuffles_freed(self.spark):
            updates = materialize(updates, "merge")
        touched = self._touched(updates, buckets)
        base = self._open([f for b, f in folders.items() if b in touched], schema)
        # the rows are dealt by bucket once; the row of each key that stands is found there
        from themeflow.operators.state import first_of_dealt, stored_and_new
        rows = [base, updates.select(*base.columns).dropDuplicates(self.keys)] if skip_existing else [base, updates]
        both, order = stored_and_new(*(reversed(rows) if skip_existing else rows), self.keys)
        stands = first_of_dealt(self._dealt(both, buckets), ["__bucket", "__part", *self.keys], order)
        new = self._put(stands.drop("__new", "__seq"))
        return self._commit(folders | new, schema, buckets, None, name)


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``root``, its files' layouts merged:
    a column that some files lack is null in their rows."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(f"no tables at {root}")
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(p, name)):
        raise ValueError(f"{root} does not contain a table {name!r}")
    return spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/{name}")


def write_workspaces(df: DataFrame, root: str, column: str, mode: str = "overwrite") -> None:
    """All workspaces at once: the value of ``column`` names the row's."""
    name = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)[^\w-]+", "")
    (df.withColumn("workspace", F.when(name == "", F.lit("default")).otherwise(name))
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("workspace").parquet(root))


def write_workspace_table(df: DataFrame, root: str, workspace: str, mode: str = "overwrite") -> None:
    """Tables of many subjects in one layout, one partition per workspace;
    readers filtering on ``workspace`` only list that partition."""
    (df.withColumn("workspace", F.lit(workspace_name(workspace)))
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("workspace").parquet(root))


def read_workspace_table(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """One workspace: its folder alone is listed and read. (A filter on the
    column would compare numbers where all names look like numbers.)"""
    path = f"{root.rstrip('/')}/workspace={workspace_name(workspace)}"
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no workspace {workspace_name(workspace)!r} at {root}")
    return spark.read.parquet(path)
