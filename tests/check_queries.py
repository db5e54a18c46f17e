"""Run catalog queries beside their SQL counterparts: ``python tests/check_queries.py [sf_dir] [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from sparkcohort.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def compare(df, con, sql: str) -> str:
    """Empty when columns and rows agree, else the first difference."""
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    theirs = sorted((tuple(_cell(row[i]) for i in order) for row in result.fetchall()), key=key)
    mine = sorted((tuple(_cell(row[c]) for c in columns) for row in df.collect()), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}; mine {mine[:2]} theirs {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ in {columns}: {bad[0][0]} != {bad[0][1]}" if bad else ""


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con, failures = local_session("8"), connect(sf_dir), 0
    oracle = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        if name not in oracle:
            print(f"{name:28s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            message = compare(query(spark, sf_dir), con, oracle[name])
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:700]}"
        failures += bool(message)
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not message else 'DIFFERS ' + message}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
