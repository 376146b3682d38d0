"""Run registered queries beside their SQL: ``python -m checks.compare [sf] [name …]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    import duckdb

    from checks import ORACLE, QUERIES
    from stillwave.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark = build_session("compare", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got_cols, got = rows_of(df.columns, df.collect())
            took = time.time() - began
            if name not in ORACLE:
                print(f"rows  {name:44s} {len(got):8d} rows {took:6.1f}s (no SQL)", flush=True)
                continue
            began = time.time()
            cur = db.execute(ORACLE[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            sql_took = time.time() - began
            if got_cols != want_cols:
                bad += 1
                print(f"COLS  {name}: {got_cols} vs {want_cols}", flush=True)
            elif got != want:
                bad += 1
                print(f"DIFF  {name}: {len(got)} vs {len(want)} rows", flush=True)
                a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
                print("   ", got_cols, "\n    spark", a, "\n    sql  ", b, flush=True)
            else:
                print(f"ok    {name:44s} {len(got):8d} rows {took:6.1f}s sql {sql_took:.1f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
