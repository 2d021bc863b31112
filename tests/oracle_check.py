"""Run named queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return f"{value + 0.0:.6f}"
        return str(value)

    return (
        [columns[i] for i in order],
        sorted(tuple(cell(row[i]) for i in order) for row in rows),
    )


def spark_result(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def duck_result(con, sql):
    cursor = con.execute(sql)
    return canonical([c[0] for c in cursor.description], cursor.fetchall())


def compare(spark, con, run, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    names, rows = spark_result(run(spark, sf_dir))
    other_names, other_rows = duck_result(con, sql)
    if names != other_names:
        return f"columns {names} against {other_names}", len(rows)
    if rows != other_rows:
        ours = [row for row in rows if row not in set(other_rows)][:3]
        theirs = [row for row in other_rows if row not in set(rows)][:3]
        return f"{len(rows)} rows against {len(other_rows)}; {ours} / {theirs}", len(rows)
    return None, len(rows)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from bench import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, failed = make_session("oracle-check"), connect(sf_dir), []
    sql = oracle_sql()
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                difference, rows = compare(spark, con, run, sql[name], sf_dir)
            else:
                difference, rows = None, len(run(spark, sf_dir).collect())
        except Exception as fault:  # report every query, then fail
            difference, rows = f"{type(fault).__name__}: {str(fault)[:1500]}", 0
        print(
            f"{'ok ' if difference is None else 'BAD'} {name} rows={rows}"
            f" {time.time() - start:.2f}s {difference or ''}",
            flush=True,
        )
        if difference:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
