"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    scols, srows = canon(df.columns, srows)
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    con = duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    dcols, drows = canon(dcols, drows)
    ok = scols == dcols and srows == drows
    info = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if not ok:
        info["spark_cols"], info["oracle_cols"] = scols, dcols
        diff_s = [r for r in srows if r not in set(drows)][:3]
        diff_d = [r for r in drows if r not in set(srows)][:3]
        info["spark_only"], info["oracle_only"] = diff_s, diff_d
    return info


def main(argv):
    from themeflow.session import build_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            info = compare(spark, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            info = dict(name=name, ok=False, error=repr(exc)[:2000])
        bad += info.get("ok") is False
        print(info, flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
