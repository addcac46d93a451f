"""Compare registered queries with their SQL on DuckDB: names, row multisets, exact values.

Run as ``python tests/oracle_check.py <sf_dir> [query ...]``.
"""

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None if equal, else a short text."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if actual == expected:
        return None
    extra, lacking = set(actual) - set(expected), set(expected) - set(actual)
    return f"{len(actual)} rows != {len(expected)}; spark only {sorted(extra)[:3]}; sql only {sorted(lacking)[:3]}"


def main(sf_dir, *names):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tallyloom import build_session

    spark = build_session("check", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_checkpoint_dir=tempfile.mkdtemp(prefix="oracle-"))
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), oracle_sql()
    bad = 0
    for name, make in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(make(spark, sf_dir), con, oracles[name]) if name in oracles else "no SQL"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:26} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
