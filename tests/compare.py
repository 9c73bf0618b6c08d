"""Run the catalog's queries against DuckDB: python tests/compare.py [sf_dir] [name ...]."""

import datetime as dt
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def sparked(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def main():
    from pyspark.sql import SparkSession

    from memloom.plans.catalog import ORACLE, QUERIES

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in args or QUERIES:
        t0 = time.time()
        try:
            cols, got = sparked(QUERIES[name](spark, sf))
        except Exception as problem:
            print(f"ERR  {name}: {str(problem)[:600]}", flush=True)
            bad += 1
            continue
        t1 = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS {name} {len(got)} {t1:.2f}s", flush=True)
            continue
        t0 = time.time()
        try:
            want_cols, want = duck(con, ORACLE[name])
        except Exception as problem:
            print(f"SQL  {name}: {str(problem)[:600]}", flush=True)
            bad += 1
            continue
        ok = cols == want_cols and got == want
        print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got)}/{len(want)} {t1:.2f}s duck {time.time() - t0:.2f}s", flush=True)
        if not ok:
            bad += 1
            print("   cols", cols, want_cols)
            a, b = set(got), set(want)
            print("   spark only", sorted(a - b, key=repr)[:3])
            print("   duck only ", sorted(b - a, key=repr)[:3], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
