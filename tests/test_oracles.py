"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    info = compare(spark, SF, name, E.queries()[name], E.oracle_sql().get(name))
    # without SQL the query must run; its own tests hold it against brute force
    assert info["ok"] is (True if name in E.oracle_sql() else None), info


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["rank", "theme"]
