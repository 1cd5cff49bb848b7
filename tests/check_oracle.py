"""Run registered queries next to their SQL. Usage: check_oracle.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v
    rows = [tuple(clean(v) for v in row) for row in df[cols].itertuples(index=False, name=None)]
    norm = lambda v: float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, sf_dir, name):
    t0 = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}", t1 - t0, 0.0, len(got) >= 0
    want = con.sql(sql).df()
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", t1 - t0, t2 - t1, False
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"{len(a)} rows equal", t1 - t0, t2 - t1, True
    only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"{len(a)} vs {len(b)} rows; {sorted(got.columns)}\n   spark only {only_a}\n   sql only {only_b}", t1 - t0, t2 - t1, False


if __name__ == "__main__":
    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        try:
            msg, ts, tq, ok = compare(spark, con, sf, n)
        except Exception as e:
            msg, ts, tq, ok = f"{type(e).__name__}: {str(e)[:350]}", 0, 0, False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} spark {ts:.1f}s sql {tq:.1f}s {msg}", flush=True)
    print("failed:", bad)
