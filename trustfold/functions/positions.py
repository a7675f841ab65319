"""Exact positions and carries over ordered groups of any size.

A plain ``row_number()`` sends a whole group through one task. These
helpers cut a group into ordered slices first, number the rows inside a
slice, and add the row count of the slices before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.sizing import BROADCAST_ROWS, broadcast_if_small
from trustfold.functions.storage import durable

SLICE_ROWS = 1_000_000
#: Cuts of an order at most; they travel with the plan.
MOST_CUTS = 5_000


def hex_digits_for(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    """Leading hex digits of a digest that cut ``rows`` rows into slices of about ``slice_rows``."""
    return 0 if rows <= slice_rows else min(6, math.ceil(math.log(rows / slice_rows, 16)))


def quantile_cuts(df: DataFrame, col: str, rows: int, rows_per_slice: int, most: int = MOST_CUTS) -> list[int]:
    """Sorted values that begin slices of about ``rows_per_slice`` rows each; the first is the least value.

    Cuts are values that occur, so clustered, sparse or negative ids give
    slices as full as dense ones; only equal values can fill one beyond that.
    At most ``most`` numbers come to the driver.
    """
    n = max(1, min(most, -(-rows // rows_per_slice)))
    shares = [i / n for i in range(n)]
    found = df.agg(F.min(col).alias("least"), F.percentile_approx(col, shares, max(10_000, 20 * n)).alias("cuts")).first()
    return [] if found["least"] is None else sorted({found["least"], *found["cuts"]})


def cut_of(value: Column, cuts: list[int]) -> Column:
    """Number of the slice that holds ``value``, found by halving steps over the sorted cuts; 0 for what lies before them."""
    borders = F.array(*map(F.lit, cuts))
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]

    def place(bound: Column) -> Column:
        def halve(at: Column, step: Column) -> Column:
            return F.when(F.get(borders, at + step) <= bound, at + step).otherwise(at)

        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)

    # the variable of a transform, so that a computed value is computed once and not at every step
    return F.element_at(F.transform(F.array(value), place), 1)


def sliced_position(df: DataFrame, group: list[str], order: list[Column], cut: Column, out: str) -> DataFrame:
    """0-based position of each row in its group by ``order``.

    ``cut`` must not decrease along ``order`` and should give slices small
    enough for one task. The first pass counts per slice, with partial
    aggregation, and writes the counts; only the second pass moves rows, by
    (group, slice), and computes what ``order`` asks for behind the shuffle.
    """
    keyed = df.withColumn("_cut", cut)
    keys = [*group, "_cut"]
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n"),
        "offsets",
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        keyed.repartition(*keys).withColumn("_local", local).join(broadcast_if_small(offsets), keys)
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_cut", "_local", "_before")
    )


def range_position(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in its group by ``order``, for orders without a natural slice.

    Rows are range-partitioned by (group, order), so a hot group spans many
    partitions. The sorted layout is written once: both passes below must
    see the same partition bounds, also after a retry.
    """
    keys = [F.col(g) for g in group]
    laid = durable(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33)),
        "positions",
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        laid.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        laid.join(broadcast_if_small(spans), [*group, "_part"])
        .withColumn(out, (F.col("_before") + F.col("_seq") - F.col("_first")).cast("bigint"))
        .drop("_seq", "_part", "_first", "_before")
    )


def position(df: DataFrame, group: list[str], order: list[Column], out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """0-based position of each row in its group by ``order``.

    Groups of at most ``slice_rows`` rows are numbered by one window. Larger
    ones, at most rows / slice_rows of them, go through ``range_position``.
    """
    local = (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint")
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slice_rows).select(*group)
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return df.withColumn(out, local)
    if found > BROADCAST_ROWS:
        return range_position(df, group, order, out)
    hot = F.broadcast(hot)
    return (
        df.join(hot, group, "left_anti").withColumn(out, local)
        .unionByName(range_position(df.join(hot, group, "left_semi"), group, order, out))
    )


def previous_value(df: DataFrame, group: list[str], step: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Value of the preceding row in the group, with the group cut into blocks of ``block`` steps.

    The first row of a block takes the last value of the block before it.
    """
    keyed = df.withColumn("_block", F.floor(F.col(step) / F.lit(block)))
    keys = [*group, "_block"]
    carry = (
        keyed.groupBy(*keys).agg(F.max_by(value, step).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("_block")))
        .drop("_last")
    )
    inside = F.lag(value).over(Window.partitionBy(*keys).orderBy(step))
    return (
        keyed.withColumn("_inside", inside).join(carry, keys)
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_block", "_inside", "_carry")
    )


def maximum_before(df: DataFrame, group: list[str], step: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Largest value among the rows before this one in the group, NULL on the first row."""
    keyed = df.withColumn("_block", F.floor(F.col(step) / F.lit(block)))
    keys = [*group, "_block"]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        keyed.groupBy(*keys).agg(F.max(value).alias("_top"))
        .withColumn("_carry", F.max("_top").over(earlier))
        .drop("_top")
    )
    inside = F.max(value).over(
        Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.withColumn("_inside", inside).join(carry, keys)
        .withColumn(out, F.greatest("_inside", "_carry"))
        .drop("_block", "_inside", "_carry")
    )
