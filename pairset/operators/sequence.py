"""Ordered, per-series operators: positions, sliding means, differences and running bests.

A window over ``partition by series`` puts a whole series into one task. That is the right plan while every
series is short, which is checked first. When one series exceeds ``block_rows``, the table is laid out in
global (series, order) order and numbered without gaps, and the windows run over fixed-size blocks of that
numbering instead. Sliding frames borrow the rows before a block from its predecessor, running values
carry an aggregate per block; both give the same result as the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairset.operators.joins import join_null_safe
from pairset.schema import null_if_nan
from pairset.session import checkpointed

BLOCK_ROWS = 2_000_000
#: Up to this k Spark prunes a ranked group before the shuffle.
PRUNED_BELOW = 1_000

POS, BLOCK = "_pos", "_block"
_VALUE, _SO_FAR = "_value", "_so_far"
_SHIFT = 1 << 33


def longest_series(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the longest series and of the whole table."""
    if not keys:
        n = df.count()
        return n, n
    row = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], total: int, block_rows: int) -> DataFrame:
    """Number all rows 0, 1, 2, ... in (keys, order) order and cut the numbering into blocks.

    ``order`` has to be unique within a series. The range layout is materialised once, since sampled range
    bounds may differ between two evaluations. The offset table has one row per partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_rows))
    by = [F.col(c) for c in (*keys, *order)]
    ranged = checkpointed(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.floor(F.col("_mid") / _SHIFT).cast("int")
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(POS, F.col("_offset") + F.col("_mid") % _SHIFT)
        .withColumn(BLOCK, F.floor(F.col(POS) / block_rows).cast("bigint"))
        .drop("_mid", "_part", "_offset")
    )


def with_halo(laid: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Copy each row into all blocks that the ``rows`` rows after it reach; ``_home`` marks the originals."""
    blocks = F.sequence(F.col(BLOCK), F.floor((F.col(POS) + rows) / block_rows).cast("bigint"))
    return (
        laid.withColumn("_in", F.explode(blocks))
        .withColumn("_home", F.col("_in") == F.col(BLOCK))
    )


def _finish(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_in", "_home", POS, BLOCK)


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 100,
    out: str = "rolling_mean", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the last ``window`` values of a series, up to and including the row.

    Rows without a value (NULL or NaN) do not enter the mean and carry the one before them.
    """
    measured = F.col(_VALUE).isNotNull()
    valued = with_value(df, value)
    longest, total = longest_series(valued, keys)
    frame = (-(window - 1), 0)
    if longest <= block_rows:
        # frames run over the number of values so far, which rows without a value share with the one before
        so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        last = W.partitionBy(*keys).orderBy(_SO_FAR).rangeBetween(*frame)
        counted = valued.withColumn(_SO_FAR, F.count(_VALUE).over(so_far))
        return counted.withColumn(out, F.avg(_VALUE).over(last)).drop(_VALUE, _SO_FAR)
    halo = with_halo(laid_out(valued.where(measured), keys, order, total, block_rows), window - 1, block_rows)
    w = W.partitionBy("_in", *keys).orderBy(POS).rowsBetween(*frame)
    means = _finish(halo.withColumn(out, F.avg(_VALUE).over(w)))
    gaps = valued.where(~measured).withColumn(out, F.lit(None).cast("double"))
    return last_known(means.unionByName(gaps), keys, order, out, block_rows).drop(_VALUE)


def with_value(df: DataFrame, value: str) -> DataFrame:
    """``df`` with the value as a number under a name of its own, NaN as NULL."""
    return df.withColumn(_VALUE, null_if_nan(F.col(value).cast("double")))


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """NULLs of a column replaced by the last value before them in the series, where there is one."""
    longest, total = longest_series(df, keys)
    if longest <= block_rows:
        before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(before))
    laid = laid_out(df, keys, order, total, block_rows)
    known = F.when(F.col(column).isNotNull(), F.col(POS))
    per_block = laid.groupBy(*keys, BLOCK).agg(F.max_by(column, known).alias("_l"))
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carry = per_block.withColumn("_carry", F.last("_l", ignorenulls=True).over(earlier)).drop("_l")
    inside = W.partitionBy(BLOCK, *keys).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    filled = join_null_safe(laid, carry, [*keys, BLOCK])
    return filled.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(inside), "_carry")).drop("_carry", POS, BLOCK)


def step_time(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, total_steps: int, step: str,
    window: int = 50, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Time since the previous row, its mean over the last ``window`` rows and the time left.

    ``at`` is the row's time as a number, whole microseconds or seconds; results are in its unit. ``eta``
    is ``max(0, total_steps - step)`` times the mean; the first row of a series has no predecessor, so its
    step time is NULL and its ETA zero.
    """
    rows = df.withColumn("_at", at)
    longest, total = longest_series(rows, keys)
    part: list[str] = list(keys)
    by: list[str] = list(order)
    blocked = longest > block_rows
    if blocked:
        rows = with_halo(laid_out(rows, keys, order, total, block_rows), window, block_rows)
        part, by = ["_in", *keys], [POS]
    w = W.partitionBy(*part).orderBy(*by)
    timed = rows.withColumn("step_time", F.col("_at") - F.lag("_at").over(w))
    timed = timed.withColumn("mean_step_time", F.avg("step_time").over(w.rowsBetween(-(window - 1), 0)))
    left = F.greatest(F.lit(total_steps) - F.col(step), F.lit(0))
    timed = timed.withColumn("eta", left * F.coalesce(F.col("mean_step_time"), F.lit(0.0))).drop("_at")
    return _finish(timed) if blocked else timed


def running_best(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, mode: str = "min",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``best_before`` and ``is_best``: strictly better than every earlier value of the series.

    A NULL or NaN value is never best and no later value is measured against it.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"unknown mode {mode!r}; use min or max")
    best = F.min if mode == "min" else F.max
    pick = F.least if mode == "min" else F.greatest
    df, value = with_value(df, value), _VALUE
    longest, total = longest_series(df, keys)
    if longest <= block_rows:
        earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        marked = df.withColumn("best_before", best(value).over(earlier))
    else:
        laid = laid_out(df, keys, order, total, block_rows)
        per_block = laid.groupBy(*keys, BLOCK).agg(best(value).alias("_b"))
        before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
        carry = per_block.withColumn("_carry", best("_b").over(before)).drop("_b")
        inner = W.partitionBy(BLOCK, *keys).orderBy(POS).rowsBetween(W.unboundedPreceding, -1)
        marked = (
            join_null_safe(laid, carry, [*keys, BLOCK])
            .withColumn("best_before", pick(F.col("_carry"), best(value).over(inner)))
            .drop("_carry", POS, BLOCK)
        )
    v, b = F.col(value), F.col("best_before")
    better = v < b if mode == "min" else v > b
    return marked.withColumn("is_best", F.coalesce(v.isNotNull() & (b.isNull() | better), F.lit(False))).drop(_VALUE)


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """0-based position of each row within its series; without keys, within the table."""
    longest, total = longest_series(df, keys)
    if longest <= block_rows:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    laid = laid_out(df, keys, order, total, block_rows)
    if not keys:
        return laid.withColumn(out, F.col(POS)).drop(POS, BLOCK)
    # A series starts inside the block, or reaches back from the block's first row: one start per
    # (series, block), carried along the few blocks of a series.
    per_block = laid.groupBy(*keys, BLOCK).agg(F.min(POS).alias("_first"))
    start = F.min("_first").over(W.partitionBy(*keys))
    starts = per_block.select(*keys, BLOCK, start.alias("_start"))
    return (
        join_null_safe(laid, starts, [*keys, BLOCK])
        .withColumn(out, F.col(POS) - F.col("_start"))
        .drop("_start", POS, BLOCK)
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, pruned_below: int = PRUNED_BELOW) -> DataFrame:
    """The first ``k`` rows of each group.

    Below ``pruned_below``, Spark itself prunes every group to ``k`` rows per task before the shuffle. Larger ``k`` are cut in a range
    layout by key and order, which deals a large group to many tasks: rows are numbered inside a (task, group), the counts of
    the tasks before are added, and no task ranks a whole group. ``order`` should have few ties, as equal rows share a task.
    """
    if k < pruned_below:
        outer = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(outer)).where(F.col("_rn") <= k).drop("_rn")
    by = [*[F.col(c) for c in keys], *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    inner = W.partitionBy("_part", *keys).orderBy(*order)
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < k).drop("_n")
    numbered = ranged.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k)
    return join_null_safe(numbered, starts, ["_part", *keys]).where(F.col("_before") + F.col("_rn") <= k).select(df.columns)
