"""Distributed ranking operators equal the window functions they replace,
including when one key holds a third of the rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from innkeep.operators.ranking import global_rank, lag_within_groups, page, rank_within_groups


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(50)}"
        rows.append((i, g, rnd.randrange(100), rnd.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "id long, g string, v int, s string")


def test_global_rank_equals_row_number(spark):
    df = _skewed(spark)
    got = global_rank(df, [F.col("v").desc(), F.col("id")], num_partitions=7).select("id", "rank")
    want = df.select("id", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).alias("rank"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_rank_within_groups_equals_partitioned_row_number(spark):
    df = _skewed(spark)
    got = rank_within_groups(df, ["g"], [F.col("v").asc_nulls_first(), F.col("id")]).select("id", "pos")
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "id")
    want = df.select("id", F.row_number().over(w).cast("long").alias("pos"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_lag_within_groups_equals_lag(spark):
    df = _skewed(spark)
    got = lag_within_groups(df, ["g"], ["id"], ["s", "v"]).select("id", "prev_s", "prev_v")
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("id", F.lag("s").over(w).alias("prev_s"), F.lag("v").over(w).alias("prev_v"))
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_hot_group_spread_over_partitions(spark):
    df = _skewed(spark)
    parts = (df.repartitionByRange(8, "g", "v", "id").select(F.spark_partition_id().alias("p"), "g")
             .where("g = 'hot'").select("p").distinct().count())
    assert parts > 1


def test_page_offsets(spark):
    df = _skewed(spark, n=95)
    p10 = page(df, [F.col("id")], 10).collect()
    assert [r.id for r in p10] == list(range(90, 95))
    assert [r.page_pos for r in p10] == [1, 2, 3, 4, 5]
    assert page(df, [F.col("id")], 11).count() == 0


def test_global_rank_consistent_for_every_consumer(spark):
    """Counts and rows must come from the same range partitioning even when
    consumers prune different columns (a self-join on the rank)."""
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(1000), f"p{rnd.randrange(10)}") for i in range(40000)]
    df = spark.createDataFrame(rows, "id long, k int, payload string")
    r = global_rank(df, ["k", "id"], rank_col="r", num_partitions=16)
    assert r.select("r").distinct().count() == 40000
    nxt = r.select((F.col("r") - 1).alias("r"), F.col("payload").alias("next_payload"))
    assert r.join(nxt, "r", "left").count() == 40000


def test_page_below_one_is_an_error(spark):
    import pytest
    with pytest.raises(ValueError):
        page(_skewed(spark, n=5), [F.col("id")], 0)
