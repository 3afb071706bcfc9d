"""Local correctness check: every registered query vs its DuckDB oracle.

Usage: python tests/check_oracle.py [sf_dir] [query ...]
Compares row count, column names and the multiset of rows (columns sorted by
name).  Prints one line per query and a JSON summary at the end.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from regiopanel.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
          "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("RP_EXACT") else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[4] == "-" else str(v)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Optional session variations, e.g. RP_CONF="spark.sql.ansi.enabled=false;spark.sql.session.timeZone=PST"
    for kv in filter(None, os.environ.get("RP_CONF", "").split(";")):
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    result = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {str(e)[:300]}")
            result[name] = "spark-error"
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows={len(srows)} (no oracle) {dt:.1f}s")
            result[name] = "rows-only"
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(e)[:400]}")
            result[name] = "sql-error"
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        a, b = rows_of(cols, srows), rows_of(ocols, orows)
        ok = ok_cols and a == b
        status = "OK" if ok else "MISMATCH"
        print(f"{name:28s} {status} spark={len(srows)} oracle={len(orows)} {dt:.1f}s")
        if not ok:
            if not ok_cols:
                print("   cols spark:", sorted(cols), "\n   cols sql:  ", sorted(ocols))
            else:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:3])
                print("   only sql:  ", list(sb - sa)[:3])
                print("   n diff:", len(sa - sb), len(sb - sa))
        result[name] = status
    print(json.dumps(result))


if __name__ == "__main__":
    main()
