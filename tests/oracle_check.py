"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py [sf] [name…]"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def duck(root):
    import duckdb
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def compare(spark, con, root, q):
    """None when equal, else a short description of the first difference."""
    df = q.run(spark, root)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return None
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"
    return None


def session(cpus="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    from loomtrace import catalog
    args = sys.argv[1:]
    sf = args[0] if args else "0.001"
    root = f"/root/testdata/sf{sf}"
    reg = catalog.load()
    picked = args[1:] or list(reg)
    spark, con = session(), duck(root)
    bad = 0
    for name in picked:
        t0 = time.time()
        try:
            why = compare(spark, con, root, reg[name])
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:900]}"
        bad += why is not None
        tag = "ok  " if why is None else "FAIL"
        print(f"{tag} {name} {time.time() - t0:.1f}s {'(rows only)' if reg[name].sql is None else ''} {why or ''}"[:1500], flush=True)
    print("failed", bad, "of", len(picked))


if __name__ == "__main__":
    main()
