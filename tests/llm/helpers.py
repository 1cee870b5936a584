"""Helpers of these tests."""


def small_docs(spark, n=200):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id < {n}")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)
