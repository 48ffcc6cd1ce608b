"""The driver contract of __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry_module()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "hotel_id" in df.columns
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    assert all(callable(f) for f in q.values())
    again = m.entry(spark)
    assert again.schema == df.schema            # stable schema
    small = q["agg_total_hotels"](spark, "/root/testdata/sf0.001/").collect()   # trailing slash accepted
    assert small[0].total_hotels > 0
