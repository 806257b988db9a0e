"""Run registered queries on Spark and their oracle SQL on DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: EXACT (values identical), NEAR (within 1e-9
relative) or FAIL with a reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from foldwise.session import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
    except Exception:  # noqa: BLE001
        pass
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return v
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    out.sort(key=lambda r: tuple((x is None, str(x) if not isinstance(x, (int, float)) or
                                  isinstance(x, bool) else f"{x:+.9e}") for x in r))
    return cols, out


def compare(spdf, ddf):
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(ddf)
    if sc != dc:
        return "FAIL", f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return "FAIL", f"rows {len(sr)} vs {len(dr)}"
    exact = True
    for a, b in zip(sr, dr):
        for i, (x, y) in enumerate(zip(a, b)):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and x is not None \
                    and y is not None and not isinstance(x, bool):
                if abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)):
                    exact = False
                    continue
            return "FAIL", f"col {sc[i]}: spark={x!r} duck={y!r} row={a}"
    types = {c: (str(spdf[c].dtype), str(ddf[c].dtype)) for c in sc
             if str(spdf[c].dtype) != str(ddf[c].dtype)}
    if types:
        return ("EXACT" if exact else "NEAR"), f"dtype diffs {types}"
    return ("EXACT" if exact else "NEAR"), ""


def run(sf_dir: str, names=None, spark=None):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    from foldwise.session import get_session
    spark = spark or get_session(8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        if name not in orc:
            continue
        t = time.time()
        try:
            spdf = qs[name](spark, sf_dir).toPandas()
            t1 = time.time() - t
            ddf = con.sql(orc[name]).df()
            status, why = compare(spdf, ddf)
        except Exception as e:  # noqa: BLE001
            status, why, t1 = "FAIL", f"{type(e).__name__}: {str(e)[:300]}", time.time() - t
        results[name] = (status, why)
        print(f"{status:5s} {name:32s} {t1:6.2f}s {why}", flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
