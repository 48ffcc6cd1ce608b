"""Benchmark: run the headline answers and jobs at one scale factor.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver) after one untimed warm-up run of the whole
set; the reported time per query is the best of ``BENCH_REPEAT`` runs.
Prints ONE JSON line.

``value``/``queries`` time the keys on the tables as the driver gives them
(domain tables derived from the base parquet inside every query).  Unless
BENCH_STORED=0, the domain tables are then published once in the partitioned
layout (``innkeep.sources.layout``; ``publish_seconds``) and the same keys
are timed on them (``stored_value``/``stored_queries``): how a deployment
keeps its tables.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 1), BENCH_ALL=1 to time every registered key,
     BENCH_STORED=0 to skip the stored-layout run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hotel_directory", "hotel_admin_search", "hotel_search_city_country", "hotel_search_price_rating",
    "booking_history", "join_app_lookup", "join_left_chain", "agg_nest_bookings", "sort_price_asc",
    "sort_availability", "agg_having_total", "validate_bookings", "validate_hotels", "audit_constraints",
    "sanitize_text", "ingest_reviews", "ingest_maintenance", "update_maintenance", "cancel_bookings",
    "ingest_hotels", "upsert_hotels_rooms", "ingest_bookings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    from innkeep.registry import QUERIES, load_all
    from innkeep.session import get_session
    from innkeep.sources.fixtures import Fixtures

    warehouse = tempfile.mkdtemp(prefix="run-bench-wh-")   # local bench only
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": "16g", "spark.sql.warehouse.dir": warehouse})
    load_all()
    keys = sorted(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    fx = Fixtures(spark, sf_dir)

    def run(key: str, tables) -> float:
        t = time.perf_counter()
        QUERIES[key](tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run(keys[0], fx)  # JVM / code-cache warm-up
    times = {key: round(min(run(key, fx) for _ in range(repeat)), 3) for key in keys}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_seconds_headline" if len(keys) == len(HEADLINE) else "total_seconds_all",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    if os.environ.get("BENCH_STORED", "1") != "0":
        try:
            from innkeep.sources.layout import CatalogTables, publish_tables
            t = time.perf_counter()
            publish_tables(fx, "lodging_bench", buckets=cpus * 2)
            out["publish_seconds"] = round(time.perf_counter() - t, 3)
            stored = CatalogTables(spark, "lodging_bench", base=fx)
            st = {key: round(min(run(key, stored) for _ in range(repeat)), 3) for key in keys}
            out["stored_value"] = round(sum(st.values()), 3)
            out["stored_queries"] = st
        except Exception as e:  # the primary figures stand on their own
            out["stored_error"] = f"{type(e).__name__}: {str(e)[:200]}"
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
