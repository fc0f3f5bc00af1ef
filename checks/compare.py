"""Run queries in Spark and their oracle SQL in DuckDB on the same files and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"DECIMAL {value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(float(f"{value:.9g}"))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str):
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; spark only {extra}; oracle only {lack}"
    return None if got else "empty"


def main() -> int:
    from checks import registry
    from ledgerloom.session import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle, bad = connect(folder), registry.queries(), registry.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            note = compare(frame, con, oracle[name]) if name in oracle else f"rows only: {frame.count()}"
        except Exception as error:  # report and go on
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if note and not note.startswith("rows only"):
            bad += 1
        print(f"{'ok  ' if not note else 'NOTE'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
