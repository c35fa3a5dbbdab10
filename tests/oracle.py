"""Compares registered queries with their SQL on DuckDB: column names, row count, values."""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return int(v) if int(v) == v else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    got_cols, got = _rows(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return None if got else "both sides are empty"
    extra, missing = list((got - want).elements()), list((want - got).elements())
    return f"{sum(got.values())} rows vs {sum(want.values())}; only spark {extra[:3]}; only sql {missing[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from runlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else list(entry.queries())
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            problem = compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {(problem or '')[:1200]}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
