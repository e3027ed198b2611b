"""Compares registered queries with their SQL in DuckDB, as the driver does.

    python tests/oracle_check.py SF_DIR [NAME...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def table_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    got = query(spark, sf_dir)
    names, rows = table_of(got.columns, got.collect())
    con.execute(sql)
    wanted_names, wanted = table_of([c[0] for c in con.description], con.fetchall())
    if names != wanted_names:
        return f"columns {names}, wanted {wanted_names}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows, wanted {len(wanted)}"
    wrong = [(a, b) for a, b in zip(rows, wanted, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, bad = connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sql:
        t = time.time()
        try:
            why = compare(spark, con, queries[name], sql[name], sf_dir)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(why)
        print(f"{name}: {why or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print(f"{bad} differ")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
