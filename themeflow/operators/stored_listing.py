"""A listing stored in its order, so that a page opens the files that hold it.

Rows lie range-sorted in files. A small catalog has the rows per file, status
and theme; from it follows, for any filter, which file holds the n-th row.
A page or a selection then opens these files alone: nothing is ordered anew
and no other id is read. The copy shows the items as they were when stored;
``StoredListing.store`` writes the next version beside the one being read."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeflow import schemas as S
from themeflow.operators.browse import display_rows, listing_order, parse_range_selection
from themeflow.operators.filters import status_filter
from themeflow.sources.tables import VersionedTable, file_paths

_SHOWN = ["id", "status", "created_utc", "snippet", "tag_display"]


class StoredListing:
    """Versions of a stored listing under ``root``: the table ``files`` has
    one row per file, status and theme and is what commits a version; the rows
    lie in a folder of their own per version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = VersionedTable(spark, f"{self.root}/files")

    def store(self, items: DataFrame, annotations: DataFrame, item_type: str, rows_per_file: int = 100_000,
              partitions: int | None = None) -> int:
        """Order all items once and write them; ids must be unique, and an
        item has at most one annotation. Returns the version."""
        themes = annotations.select(F.col("item_id").alias("__item"), F.col("consolidated_tag").alias("theme"),
                                    F.lit(True).alias("annotated"))
        rows = display_rows(items, annotations, item_type)
        rows = rows.join(themes, F.col("id") == F.col("__item"), "left").select(
            *_SHOWN, "theme", F.coalesce("annotated", F.lit(False)).alias("annotated"))
        order = listing_order()
        ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
        # the part leads the sort: the writer asks for it and sorts no second time
        ranged = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
        folder = f"{self.root}/rows/{uuid.uuid4().hex}"
        (ranged.withColumn("pos", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
         .write.option("maxRecordsPerFile", rows_per_file).partitionBy("part").parquet(folder))
        return self.files.write(self._catalog(folder))

    def _catalog(self, folder: str) -> DataFrame:
        try:
            rows = self.spark.read.option("basePath", folder).parquet(folder)
        except Exception as e:  # a listing of no rows has no file to take a schema from
            if getattr(e, "getCondition", lambda: None)() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return self.spark.createDataFrame(
                [], "folder string, file string, part int, status string, theme string, annotated boolean, rows long, "
                    "first_pos long")
        return rows.groupBy(F.col("_metadata.file_path").alias("file"), "part", "status", "theme", "annotated").agg(
            F.count("*").alias("rows"), F.min("pos").alias("first_pos")).select(
            F.lit(folder).alias("folder"), "file", "part", "status", "theme", "annotated", "rows", "first_pos")

    def _places(self, status: str, theme: str) -> DataFrame:
        """Per file the rows that a filter leaves, and those in files before
        it. The window sees one row per file."""
        cat = self.files.read()
        starts = cat.groupBy("folder", "file", "part").agg(F.min("first_pos").alias("first_pos"))
        left = _theme(status_filter(cat, status), theme).groupBy("file").agg(F.sum("rows").alias("n"))
        w = Window.orderBy("part", "first_pos")
        return starts.join(left, "file").withColumn("before", F.sum("n").over(w) - F.col("n"))

    def count(self, status: str = "All", theme: str = "All") -> int:
        """Rows that the filters leave, from the catalog alone."""
        cat = _theme(status_filter(self.files.read(), status), theme)
        return cat.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def ranges(self, ranges: list[tuple[int, int]], status: str = "All", theme: str = "All") -> DataFrame:
        """The rows whose 1-based index under the filters is in one of the
        inclusive ranges. The files that hold them are named on the driver
        (as Spark does when it lists a folder), and they alone are read."""
        def within(lo, hi):
            return [(lo <= F.lit(b)) & (hi >= F.lit(a)) for a, b in ranges]
        held = _any(within(F.col("before") + 1, F.col("before") + F.col("n")))
        chosen = self._places(status, theme).filter(held).select("folder", "file", "part", "before").collect()
        if not chosen:
            return self.spark.createDataFrame([], "id string, status string, created_utc double, snippet string, "
                                                  "tag_display string, row_index long")
        files = file_paths(self.spark, [r["file"] for r in chosen])
        rows = (self.spark.read.option("basePath", chosen[0]["folder"]).parquet(*files)
                .withColumn("file", F.col("_metadata.file_path")))
        before = self.spark.createDataFrame([(r["file"], r["before"]) for r in chosen], "file string, before long")
        # one small file per window; its rows follow those of the files before it
        w = Window.partitionBy("file").orderBy("pos")
        index = F.col("before") + F.row_number().over(w)
        found = _theme(status_filter(rows, status), theme).join(before, "file").withColumn("row_index", index)
        return found.filter(_any(within(F.col("row_index"), F.col("row_index")))).select(*_SHOWN, "row_index")

    def page(self, page_no: int, page_size: int = S.PAGE_SIZE, status: str = "All",
             theme: str = "All") -> tuple[DataFrame, int]:
        """One page, clamped to the last one, and the page count."""
        pages = max(1, math.ceil(self.count(status, theme) / page_size))
        p = min(max(1, page_no), pages)
        return self.ranges([((p - 1) * page_size + 1, p * page_size)], status, theme), pages

    def selection(self, selection: str, status: str = "All", theme: str = "All") -> DataFrame:
        """The rows that a selection like ``5, 12-15`` names."""
        return self.ranges(parse_range_selection(selection, self.count(status, theme)), status, theme)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _theme(rows: DataFrame, theme: str) -> DataFrame:
    """``theme_filter`` on rows that carry their own theme."""
    if theme == "All":
        return rows
    return rows.filter(~F.col("annotated")) if theme == "None" else rows.filter(F.col("theme") == theme)
