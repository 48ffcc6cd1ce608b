"""Largest task's record count for positions inside a group when one group
holds a third of all rows: a window partitioned by the group versus
``rank_within_groups``.  Reads task metrics from the Spark event log (written
to a fresh scratch folder).

usage: python scripts/skew_probe.py [sf_dir]
"""

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from innkeep.operators.ranking import lag_within_groups, rank_within_groups  # noqa: E402
from innkeep.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logs = tempfile.mkdtemp(prefix="run-eventlog-")
    spark = get_session("local[8]", 16, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logs})
    sc = spark.sparkContext
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    # one group owns every third line (a third of all rows)
    df = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot"))
                   .otherwise(F.col("l_suppkey").cast("string")).alias("g"),
                   "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    total = df.count()
    sc.setJobGroup("window_row_number", "window_row_number")
    df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order))) \
        .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("rank_within_groups", "rank_within_groups")
    rank_within_groups(df, ["g"], order).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("group_aggregate", "group_aggregate")
    df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("a")) \
        .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("window_lag", "window_lag")
    df.withColumn("prev", F.lag("l_extendedprice").over(Window.partitionBy("g").orderBy(*order))) \
        .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("lag_within_groups", "lag_within_groups")
    lag_within_groups(df, ["g"], order, ["l_extendedprice"]).write.format("noop").mode("overwrite").save()
    spark.stop()
    groups = {}
    job_group = {}
    for path in glob.glob(os.path.join(logs, "**", "*"), recursive=True):
        if os.path.isdir(path) or "appstatus" in os.path.basename(path):
            continue
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        for line in raw.decode("utf-8").splitlines():
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        job_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    g = job_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    if g:   # records a task received from a shuffle (grouped work)
                        groups[g] = max(groups.get(g, 0), recs)
    print(json.dumps({"rows": total, "hot_group_rows": total // 3,
                      "max_shuffle_records_one_task": groups}))


if __name__ == "__main__":
    main()
