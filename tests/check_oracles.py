"""Run registered queries beside their SQL: ``python tests/check_oracles.py [sf] [prefix...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    """Sorted rows with columns in name order, numbers as numbers."""
    cols = sorted(frame.columns)
    out = []
    for row in frame[cols].itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
                cells.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif isinstance(v, (int, float)) or type(v).__module__ == "numpy":
                cells.append(repr(round(float(v), 6) + 0.0))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return cols, sorted(out)


def compare(spark, con, fn, sql, sf_dir):
    got_cols, got = rows_of(fn(spark, sf_dir).toPandas())
    want_cols, want = rows_of(con.execute(sql).fetchdf())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} != {len(want)}; only here {extra}; only there {missing}"
    return ""


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                problem = "" if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(e))[:900]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print(f"{bad} failed; no SQL for {sorted(set(queries) - set(oracles))}; "
          f"SQL only {sorted(set(oracles) - set(queries))}")
    spark.stop()


if __name__ == "__main__":
    main()
