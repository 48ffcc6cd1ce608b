"""Ordering, ranking and paging.

``global_rank`` numbers rows 1..N along a total order without pulling all
rows through one task: the data is range-partitioned on the order key (so a
hot key's rows are spread over several partitions when the order has further
columns), each partition is sorted locally and numbered, the result is
checkpointed once, and the only global step is a prefix sum over *one row
per partition* (P rows, P = partition count).

``page`` is ``ORDER BY .. LIMIT size OFFSET (page-1)*size``: Spark plans it
as TakeOrderedAndProject, a per-partition top-k followed by a merge of at most
``page*size`` rows per partition; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.session import materialize

PAGE_SIZE = 10  # rows per page of every list answer (fixed value)


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_rank(df: DataFrame, order: Sequence[str | Column], rank_col: str = "rank",
                num_partitions: int | None = None, keep_partition: bool = False) -> DataFrame:
    """Attach ``rank_col`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key) so the result
    is deterministic and survives task retries."""
    order_cols = _cols(order)
    # Without an explicit count AQE sizes the range partitions to the data
    # (it only merges adjacent ranges, so partition ids stay in key order).
    parts = (num_partitions,) if num_partitions else ()
    ranged = (df.repartitionByRange(*parts, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # The range bounds are sampled per exchange instance, so the counts and
    # the rows must come from one materialisation, not two evaluations of
    # the plan: a reliable checkpoint in the shared checkpoint folder (also
    # what makes the numbering survive a lost executor).
    ranged = materialize(ranged)
    # One row per partition: its size and first id; prefix sums give offsets.
    per_part = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # offsets has exactly one row per partition: a bounded broadcast.
    out = ranged.join(F.broadcast(offsets.select("_pid", "_m0", "_off")), "_pid")
    out = (out.withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
           .drop("_mid", "_m0", "_off"))
    return out if keep_partition else out.drop("_pid")


def rank_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                       pos_col: str = "pos") -> DataFrame:
    """1-based position of each row inside its ``keys`` group along ``order``.

    Uses :func:`global_rank` over (keys, order), so one hot group is spread
    over many range partitions, then subtracts the group's first rank.  The
    first rank is found per (range partition, group) and then per group (two
    partial aggregates whose result has at most groups + partitions rows) and
    joined back on (range partition, group): a hot group's rows stay split by
    partition in that join too, so no task sees more than one partition's
    share of it."""
    ranked = global_rank(df, [*keys, *order], rank_col="_grank", keep_partition=True)
    per_part = ranked.groupBy("_pid", *keys).agg(F.min("_grank").alias("_pfirst"))
    first = per_part.groupBy(*keys).agg(F.min("_pfirst").alias("_gfirst"))
    starts = _null_safe_join(per_part, first, keys).select("_pid", *keys, "_gfirst")
    return (_null_safe_join(ranked, starts, ["_pid", *keys])
            .withColumn(pos_col, (F.col("_grank") - F.col("_gfirst") + 1).cast("long"))
            .drop("_grank", "_gfirst", "_pid"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a NULL key equals a NULL key."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


def page(df: DataFrame, order: Sequence[str | Column], page_no: int = 1,
         size: int = PAGE_SIZE, pos_col: str | None = "page_pos") -> DataFrame:
    """Rows ``(page_no-1)*size+1 .. page_no*size`` of ``df`` in ``order``.

    The page holds at most ``size`` rows, so numbering them with a window is
    a bounded single-task step."""
    if page_no < 1:
        raise ValueError("page must be >= 1")
    order_cols = _cols(order)
    out = df.orderBy(*order_cols).offset((page_no - 1) * size).limit(size)
    if pos_col:
        out = out.withColumn(pos_col, F.row_number().over(Window.orderBy(*order_cols)).cast("long"))
    return out


def page_count(total: Column, size: int = PAGE_SIZE) -> Column:
    """``Math.ceil(total / size)``."""
    return F.ceil(total / F.lit(size)).cast("long")


def lag_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                      cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``LAG(col) OVER (PARTITION BY keys ORDER BY order)`` for each of
    ``cols``, without a window partitioned by the key.

    Rows are ranked along (keys, order) with :func:`global_rank` and joined
    to their predecessor on ``rank - 1``: an equi-join on a unique, evenly
    spread integer, so a group holding a large share of the rows is still
    processed by many tasks.  The predecessor counts only if it has the same
    keys."""
    ranked = global_rank(df, [*keys, *order], rank_col="_r")
    prev = ranked.select((F.col("_r") + 1).alias("_r"),
                         *[F.col(k).alias(f"_pk_{k}") for k in keys],
                         *[F.col(c).alias(f"_pv_{c}") for c in cols])
    j = ranked.join(prev, "_r", "left")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_pk_{k}"))
    for c in cols:
        j = j.withColumn(prefix + c, F.when(same, F.col(f"_pv_{c}")))
    return j.drop("_r", *[f"_pk_{k}" for k in keys], *[f"_pv_{c}" for c in cols])


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str,
                sum_col: str = "before") -> DataFrame:
    """``SUM(value)`` of the rows before each row in its ``keys`` group along
    ``order`` (0 for the first), without a window over a whole group.

    Rows are range-partitioned by (keys, order), which must be a total order,
    so a hot group spans many partitions.  A window adds up the rows of one
    group within one partition only; what earlier partitions hold of the group
    comes from one total per (partition, group)."""
    order_cols = _cols([*keys, *order])
    ranged = materialize(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    inside = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = (ranged.groupBy("_pid", *keys).agg(F.sum(value).alias("_total"))
                .withColumn("_off", F.coalesce(F.sum("_total").over(earlier), F.lit(0))))
    out = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (_null_safe_join(out, per_part.select("_pid", *keys, "_off"), ["_pid", *keys])
            .withColumn(sum_col, F.col("_off") + F.col("_in")).drop("_pid", "_mid", "_in", "_off"))
