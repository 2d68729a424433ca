"""Local check: run queries() and oracle_sql() side by side (like the driver) and report matches.

    python -m tests.compare /root/testdata/sf0.01 [report ...]
"""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from rackpulse.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 9)
    return v


def main(sf_dir, names):
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(E.registry.REPORTS):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {str(e)[:400]}"); bad += 1; continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name}: rows={len(srows)} (no oracle) {ts:.1f}s"); continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: DUCKDB ERROR {str(e)[:400]}"); bad += 1; continue
        if sorted(scols) != sorted(dcols):
            print(f"{name}: COLUMNS differ spark={scols} duck={dcols}"); bad += 1; continue
        order = sorted(range(len(scols)), key=lambda i: scols[i])
        dorder = [dcols.index(scols[i]) for i in order]
        sset = sorted((tuple(norm(r[i]) for i in order) for r in srows), key=repr)
        dset = sorted((tuple(norm(r[i]) for i in dorder) for r in drows), key=repr)
        exact = sorted((tuple(r[i] for i in order) for r in srows), key=repr) == \
            sorted((tuple(float(r[i]) if hasattr(r[i], 'as_tuple') else r[i] for i in dorder) for r in drows), key=repr)
        if sset == dset:
            print(f"{name}: OK rows={len(srows)} exact={exact} {ts:.1f}s")
        else:
            bad += 1
            print(f"{name}: MISMATCH spark={len(srows)} duck={len(drows)}")
            ss, ds = set(sset), set(dset)
            print("  only spark:", [r for r in sset if r not in ds][:3])
            print("  only duck: ", [r for r in dset if r not in ss][:3])
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
