"""Time registered keys (noop sink) after a warm-up: python scripts/time_keys.py SF_DIR key ..."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innkeep.registry import QUERIES, load_all  # noqa: E402
from innkeep.session import get_session  # noqa: E402
from innkeep.sources.fixtures import Fixtures  # noqa: E402

sf, keys = sys.argv[1], sys.argv[2:]
spark = get_session("local[8]", 16)
load_all()
fx = Fixtures(spark, sf)
QUERIES["hotel_directory"](fx).write.format("noop").mode("overwrite").save()
for k in keys:
    t = time.perf_counter()
    QUERIES[k](fx).write.format("noop").mode("overwrite").save()
    print(f"{k:32s} {time.perf_counter() - t:7.2f}s", flush=True)
