"""Run registered queries next to their SQL and compare the results as sets of rows.

    python tests/compare.py [scale] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_rows, spark_names, sql_rows, sql_names) -> str:
    if sorted(spark_names) != sorted(sql_names):
        return f"columns differ: {sorted(spark_names)} and {sorted(sql_names)}"
    left, right = _rows(spark_names, spark_rows), _rows(sql_names, sql_rows)
    if len(left) != len(right):
        return f"row counts differ: {len(left)} and {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, first: {wrong[0]}"[:3000] if wrong else ""


def main() -> int:
    from tests.conftest import new_session
    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = new_session(), connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            spark_time, start = time.time() - start, time.time()
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name:24} rows={len(rows):6} no SQL  spark={spark_time:.1f}s", flush=True)
                continue
            result = con.execute(sql)
            sql_names = [d[0] for d in result.description]
            message = differences(rows, df.columns, result.fetchall(), sql_names)
            sql_types = {d[0]: str(d[1]) for d in result.description}
            types = {n: (t, sql_types.get(n)) for n, t in df.dtypes}
            odd = [f"{n}: {a} / {b}" for n, (a, b) in types.items()
                   if {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN",
                       "double": "DOUBLE"}.get(a) != b]
        except Exception as error:
            message, spark_time, odd, rows = f"{type(error).__name__}: {error}"[:2500], 0, [], []
        bad += bool(message)
        print(f"{name:24} rows={len(rows):6} {'DIFF ' + message if message else 'same'}  spark={spark_time:.1f}s "
              f"sql={time.time() - start:.1f}s {' TYPES ' + '; '.join(odd) if odd else ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
