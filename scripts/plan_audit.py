"""Run every key and classify what feeds each single-partition exchange.

A single-partition exchange is acceptable above a partial aggregate (one row
per partition) or the per-partition count table of ``global_rank``; anything
else would put unaggregated data through one task and is printed.

usage: python scripts/plan_audit.py [sf_dir]
"""

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innkeep.registry import QUERIES, load_all  # noqa: E402
from innkeep.session import get_session  # noqa: E402
from innkeep.sources.fixtures import Fixtures  # noqa: E402


def single_partition_inputs(df):
    """(child line, acceptable) for each single-partition exchange of the
    executed plan (run the DataFrame first)."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            ok = "partial_" in child or "ShuffleQueryStage" in child or re.search(r"keys=\[_pid#", child)
            out.append((child.strip(), bool(ok)))
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    load_all()
    fx = Fixtures(spark, sf)
    kinds = collections.Counter()
    for k in sorted(QUERIES):
        df = QUERIES[k](fx)
        df.write.format("noop").mode("overwrite").save()
        for child, ok in single_partition_inputs(df):
            kinds["ok" if ok else "SUSPECT"] += 1
            if not ok:
                print(k, "->", child[:160])
    print(dict(kinds))


if __name__ == "__main__":
    main()
