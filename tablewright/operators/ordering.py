"""Operators that need one total order over the whole table.

A window over everything would run as one task. These split the order into
range partitions, solve each partition on its own and connect them through a
table with one row per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.durable import scratch_path
from tablewright.operators.frequency import quoted
from tablewright.sources.tables import replace_files

# monotonically_increasing_id keeps the partition above and the row within it below this bit.
ROW_BITS = 33


def _ranged(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Sorted range partitions with ``_seg`` (partition) and ``_row`` (row in it).

    Written to the shared folder, since the places would change if a lost
    partition were computed again from a new sample of the keys.
    """
    keys = [quoted(c).asc_nulls_last() for c in order_by]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = ordered.withColumn("_place", F.monotonically_increasing_id())
    return (
        replace_files(place, scratch_path(df.sparkSession, "ranged"))
        .withColumn("_seg", F.shiftright("_place", ROW_BITS))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )


def number_rows(df: DataFrame, order_by: list[str], name: str = "_record_id") -> DataFrame:
    """Consecutive numbers from 1 in the given order.

    Remaining columns break ties, so equal keys do not pile up in one partition.
    """
    rest = [c for c in df.columns if c not in order_by]
    ranged = _ranged(df, order_by + rest)
    sizes = ranged.groupBy("_seg").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the table.
    offsets = sizes.select("_seg", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.join(F.broadcast(offsets), "_seg")
    return numbered.select(*[quoted(c) for c in df.columns], (F.col("_offset") + F.col("_row") + 1).alias(name))


def forward_backward_fill(
    df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None
) -> DataFrame:
    """Fill nulls with the last value before them, and leading nulls with the first value after.

    The fill is solved on the distinct order keys; rows sharing a key share its
    value (the largest, when they carry several). With ``partition_by`` every
    group is filled on its own.
    """
    groups = partition_by or []
    keys = groups + order_by
    largest = [F.max(quoted(c)).alias(c) for c in columns]
    by_key = df.groupBy(*[quoted(k) for k in keys]).agg(*largest)
    ranged = _ranged(by_key, keys)

    def last_before(c: str, where: str) -> Column:
        return F.max_by(quoted(c), F.when(quoted(c).isNotNull(), F.col(where)))

    def first_after(c: str, where: str) -> Column:
        return F.min_by(quoted(c), F.when(quoted(c).isNotNull(), F.col(where)))

    # One row per partition and group present in it. A group spans few partitions
    # unless it is large, and a small group never meets more than two.
    ends = ranged.groupBy("_seg", *[quoted(g) for g in groups]).agg(
        *[last_before(c, "_row").alias(f"_last_{i}") for i, c in enumerate(columns)],
        *[first_after(c, "_row").alias(f"_first_{i}") for i, c in enumerate(columns)],
    )
    earlier = Window.partitionBy(*[quoted(g) for g in groups]).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(*[quoted(g) for g in groups]).orderBy("_seg").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carried = ends.select(
        "_seg",
        *[quoted(g) for g in groups],
        *[F.last(f"_last_{i}", ignorenulls=True).over(earlier).alias(f"_prev_{i}") for i in range(len(columns))],
        *[F.first(f"_first_{i}", ignorenulls=True).over(everywhere).alias(f"_lead_{i}") for i in range(len(columns))],
    )
    within = (
        Window.partitionBy("_seg", *[quoted(g) for g in groups])
        .orderBy("_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = ranged.select(
        "_seg",
        *[quoted(k) for k in keys],
        *[F.last(quoted(c), ignorenulls=True).over(within).alias(f"_run_{i}") for i, c in enumerate(columns)],
    )
    left, right = running.alias("l"), carried.alias("r")
    same = [F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`")) for g in ["_seg", *groups]]
    filled = left.join(right, reduce(Column.__and__, same), "left").select(
        *[F.col(f"l.`{k}`").alias(f"_key_{j}") for j, k in enumerate(keys)],
        *[
            F.coalesce(f"l._run_{i}", f"r._prev_{i}", f"r._lead_{i}").alias(f"_fill_{i}")
            for i in range(len(columns))
        ],
    )
    on = reduce(Column.__and__, [quoted(k).eqNullSafe(F.col(f"_key_{j}")) for j, k in enumerate(keys)])
    joined = df.join(filled, on, "left")
    chosen = {c: F.coalesce(quoted(c), F.col(f"_fill_{i}")).alias(c) for i, c in enumerate(columns)}
    return joined.select(*[chosen.get(c, quoted(c)) for c in df.columns])
