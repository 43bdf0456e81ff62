"""Run registered queries on Spark and their SQL on DuckDB; compare results.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from statline.plans.oracle import oracle_sql  # noqa: E402
from statline.plans.registry import queries  # noqa: E402
from statline.session import get_session  # noqa: E402
from statline.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else float(v)
    if v is None or v is getattr(__import__("pandas"), "NA", None) or v is getattr(
            __import__("pandas"), "NaT", None):
        return None
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main() -> int:
    args = sys.argv[1:]
    d = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            got = qs[name](spark, d).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS {name}: {len(got)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            exp = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        gc, gr = rows_of(got)
        ec, er = rows_of(exp)
        if gc != ec:
            print(f"FAIL {name}: columns {gc} vs {ec}")
            bad += 1
            continue
        if len(gr) != len(er):
            print(f"FAIL {name}: rows {len(gr)} vs {len(er)}")
            bad += 1
            continue
        diff = [(a, b) for a, b in zip(gr, er) if a != b]
        if diff:
            print(f"FAIL {name}: {len(diff)} differing rows, e.g. {diff[:2]}")
            bad += 1
            continue
        print(f"OK   {name}: {len(gr)} rows {t1 - t0:.1f}s")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
