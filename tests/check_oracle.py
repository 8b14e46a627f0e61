"""Command-line oracle check: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_mod  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from segmint.session import get_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(sdf, con.sql(sqls[name]).df())
            else:
                res = {"spark_rows": sdf.count(), "match": None}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}", "match": False}
        res["sec"] = round(time.time() - t0, 2)
        if res.get("match") is False:
            bad += 1
        print(name, json.dumps(res, default=str)[:600], flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
