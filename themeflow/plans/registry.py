"""Query registry: name -> (Spark job over the given tables, DuckDB oracle).

Each Spark job reads whole tables of ``sf_dir`` through the bindings and
returns a DataFrame; nothing is collected. Column names match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco
