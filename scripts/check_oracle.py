"""Run registered keys in Spark and DuckDB side by side; print one line each.

usage: python scripts/check_oracle.py [sf_dir] [key-substring ...]
env:   CHECK_JSON=path writes a JSON report (per key: ok, detail, seconds)
       CHECK_SHUFFLE_PARTITIONS=n (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innkeep.oracle.compare import compare, duck_connect  # noqa: E402
from innkeep.registry import ORACLE, QUERIES, load_all  # noqa: E402
from innkeep.session import get_session  # noqa: E402
from innkeep.sources.fixtures import Fixtures  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    load_all()
    spark = get_session("local[8]", int(os.environ.get("CHECK_SHUFFLE_PARTITIONS", "8")))
    fx = Fixtures(spark, sf)
    bad = 0
    report = {}
    for key in sorted(QUERIES):
        if pats and not any(p in key for p in pats):
            continue
        t = time.time()
        try:
            df = QUERIES[key](fx)
            if key in ORACLE:
                ok, msg = compare(df, ORACLE[key], duck_connect(sf))   # one key's failure leaves the next alone
            else:
                n = df.count()
                ok, msg = True, f"rows-only {n}"
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        report[key] = {"ok": ok, "detail": msg, "seconds": round(time.time() - t, 3),
                       "oracle": key in ORACLE}
        print(f"{'OK ' if ok else 'BAD'} {key:40s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{bad} failing")
    if os.environ.get("CHECK_JSON"):
        with open(os.environ["CHECK_JSON"], "w") as f:
            json.dump({"sf_dir": sf, "failing": bad, "keys": report}, f, indent=1)


if __name__ == "__main__":
    main()
