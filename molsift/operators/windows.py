"""Scalable running totals and row numbers over a global order.

A window with no (or a low-cardinality) PARTITION BY puts every row of a
group into one task. These helpers range-partition on the order and write the
result once, so that the range a row is in is fixed before it is used twice:
for running values inside the range, and for offsets from a small table of
per-range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hint_if_small, materialise


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def running_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                sum_cols: Sequence[str], prefix: str = "cum_",
                num_ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` per group along ``order_cols``.

    Equals ``sum(c) OVER (PARTITION BY group ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` when the order is total; callers pre-aggregate ties.
    """
    gcols, ocols = list(group_cols), _cols(order_cols)
    ranged = _ranged(df, [*[F.col(g) for g in gcols], *ocols], num_ranges)
    totals = ranged.groupBy("_rng", *gcols).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    before = Window.partitionBy(*gcols).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_rng").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in gcols],
                            *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    same = F.col("_rng") == F.col("_r")
    for g in gcols:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    local_w = (Window.partitionBy("_rng", *gcols).orderBy(*ocols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = ranged.withColumns({f"_loc_{c}": F.sum(c).over(local_w) for c in sum_cols}).join(hint_if_small(offsets), same)
    return joined.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{prefix}{c}")
                                        for c in sum_cols])


def _ranged(df: DataFrame, order: list[Column], num_ranges: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order``, written once, with its range as ``_rng``."""
    parts = df.repartitionByRange(num_ranges, *order) if num_ranges else df.repartitionByRange(*order)
    return materialise(parts.withColumn("_rng", F.spark_partition_id()), "ranges")


def global_row_number(df: DataFrame, order_cols: Sequence, alias: str = "row_num",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """1-based row number along a total order (per group), without a
    single-task window."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sum(one, group_cols, order_cols, ["_one"], prefix="_rn")
    return out.withColumnRenamed("_rn_one", alias).drop("_one")


def ntile_of(row_num: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` from a 1-based row number and the row count: the first
    ``n % k`` tiles hold one row more."""
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return F.when(row_num <= big, F.floor((row_num - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((row_num - 1 - big) / q) + 1).cast("int")


def rank_desc(df: DataFrame, value: str, alias: str = "rank") -> DataFrame:
    """G1 companion: ``rank()`` by ``value`` descending, NULL last.

    Equal values share a range, so a rank is the rank in the range plus the
    rows of the ranges before; nothing is joined on the value.
    """
    order = F.col(value).desc()
    ranged = _ranged(df, [order])
    counts = ranged.groupBy(F.col("_rng").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.rank().over(Window.partitionBy("_rng").orderBy(order))
    return (ranged.withColumn("_loc", local).join(hint_if_small(offsets), F.col("_rng") == F.col("_r"))
            .select(*df.columns, (F.col("_off") + F.col("_loc")).alias(alias)))
