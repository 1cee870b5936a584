"""Trigram postings that narrow a boolean substring search to a few files.

A text that contains a term contains every run of three characters of it.
Postings name, per run, the rows that have it; a search reads the postings of
its terms' runs alone, works out which rows can satisfy the expression, opens
the files that hold them and tests the expression there on the whole text. So
results equal those of the scan, and terms of one or two characters, which
name no run, narrow nothing. All of it is DataFrame functions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.operators.filters import parse_search, search_expression
from themeflow.sources.tables import VersionedTable, file_paths

GRAM = 3


@dataclass
class Possible:
    """Whether a row can satisfy a part of a search; no condition: any can."""

    condition: Column | None

    def __and__(self, other: "Possible") -> "Possible":
        if self.condition is None or other.condition is None:
            return self if other.condition is None else other
        return Possible(self.condition & other.condition)

    def __or__(self, other: "Possible") -> "Possible":
        if self.condition is None or other.condition is None:
            return Possible(None)
        return Possible(self.condition | other.condition)

    def __invert__(self) -> "Possible":
        return Possible(None)   # rows that have all the runs may still lack the term


def grams(term: str) -> list[str]:
    """The distinct runs of a term, in lower case as the texts are."""
    low = term.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def haystack(fields) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


class TextIndex:
    """Texts and postings under ``root``, in batches. The table ``batches``
    names the folders of each and commits them; texts lie in files of
    ``rows_per_file`` rows, which is what a search opens or leaves."""

    def __init__(self, spark: SparkSession, root: str, fields=("title", "selftext"), rows_per_file: int = 2_000):
        self.spark, self.root = spark, root.rstrip("/")
        self.fields, self.rows_per_file = tuple(fields), rows_per_file
        self.batches = VersionedTable(spark, f"{self.root}/batches")

    def _folders(self) -> list[str]:
        if self.batches.latest() is None:
            return []
        return [r["folder"] for r in self.batches.read().orderBy("folder").collect()]

    def add(self, items: DataFrame, name: str | None = None) -> int:
        """Add a batch of rows; a ``name`` that is committed adds nothing.
        Returns the version."""
        if name and self.batches.holds(name):
            return next(v for v, n in self.batches._committed().items() if n == name)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        items.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{folder}/texts")
        texts = self.spark.read.schema(items.schema).parquet(f"{folder}/texts")
        # a look-ahead finds overlapping runs in one pass over the text
        runs = F.array_distinct(F.regexp_extract_all(haystack(self.fields), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
        postings = texts.select(F.explode(runs).alias("gram"), F.col("_metadata.file_path").alias("file"),
                                F.col("_metadata.row_index").alias("row"))
        # ranges of (run, row): a run that is in all texts lies in many files
        (postings.repartitionByRange("gram", "file", "row").sortWithinPartitions("gram", "file", "row")
         .write.parquet(f"{folder}/postings"))
        listed = self.spark.createDataFrame([(f,) for f in [*self._folders(), folder]], "folder string")
        return self.batches.write(listed.coalesce(1), name=name)

    def candidates(self, expression: str) -> DataFrame | None:
        """(file, row) of the rows that can satisfy the search, or None where
        any row can."""
        names: set[str] = set()

        def has(term: str) -> Possible:
            wanted = grams(term)
            names.update(wanted)
            if not wanted:
                return Possible(None)
            return Possible(F.size(F.array_except(F.array(*[F.lit(g) for g in wanted]), F.col("grams"))) == 0)

        possible = parse_search(expression)(has)
        if not isinstance(possible, Possible) or possible.condition is None:
            return None
        held = self.spark.read.schema("gram string, file string, row long").parquet(
            *[f"{f}/postings" for f in self._folders()])
        # at most one entry per run of the search in a group
        per_row = held.filter(F.col("gram").isin(sorted(names))).groupBy("file", "row").agg(
            F.collect_set("gram").alias("grams"))
        return per_row.filter(possible.condition).select("file", "row")

    def search(self, expression: str) -> DataFrame:
        """The rows whose text satisfies the expression, as
        ``search_expression`` over all rows finds them. The names of the files
        to open pass through the driver, as in any listing of a folder."""
        folders = self._folders()
        if not folders:
            raise FileNotFoundError(f"no batch under {self.root}")
        every = self.spark.read.parquet(*[f"{f}/texts" for f in folders])
        found = self.candidates(expression)
        if found is None:
            return search_expression(every, expression, self.fields)
        files = file_paths(self.spark, [r["file"] for r in found.select("file").distinct().collect()])
        if not files:
            return every.limit(0)
        return search_expression(self.spark.read.schema(every.schema).parquet(*files), expression, self.fields)
