"""Run every registered query against its oracle: ``python tests/check_oracles.py [sf_dir] [keys...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from arrlens.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    # ARRLENS_CONF="k=v,k=v" adds session settings, e.g. to force the
    # large-cluster code paths (no broadcasts, range-partitioned quantiles).
    extra = dict(kv.split("=", 1) for kv in os.environ.get("ARRLENS_CONF", "").split(",") if kv)
    spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failed = []
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            if k not in sqls:
                n = df.count()
                print(f"ROWS  {k}: {n} rows (no oracle) {time.time() - t0:.1f}s", flush=True)
                continue
            ok, msg = compare(df, con, sqls[k])
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'OK  ' if ok else 'FAIL'}  {k}: {msg} {time.time() - t0:.1f}s", flush=True)
        if not ok:
            failed.append(k)
    print("FAILED:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
