"""Scans over an order that no task holds as a whole.

Rows are cut into ranges of their order at sampled quantiles (``ranged``), so a key with most rows is spread over as
many tasks as any other rows, and values that are crowded get ranges as full as others. A scan then has three steps:
windows within a range, one row for each range and key with what passes on, and a prefix over these rows (``carry``).
Only a key that goes on from one range to the next has something carried over, so there is at most one such row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandloom.sources.shared import cut

PART = "_part"


def ranged(df: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """df with _part, the number of a row's range in an order; ranges hold about as many rows each, rows that are equal in it share one.

    The ranges are drawn once and written to the shared folder, so that all that reads them agrees.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def within(keys: list[str], *order: str | Column) -> WindowSpec:
    """The order within a range and key."""
    return Window.partitionBy(PART, *keys).orderBy(*order)


def carry(rows: DataFrame, keys: list[str], **passed: tuple[Column, str]) -> DataFrame:
    """rows with a column for each name: what passes on from earlier ranges of the same key, null where there are none.

    passed: name -> (an aggregate of a range, sum or max or min by which those of earlier ranges are put together).
    """
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = rows.groupBy(PART, *keys).agg(*(made.alias(name) for name, (made, _) in passed.items()))
    put = {"sum": F.sum, "max": F.max, "min": F.min}
    before = ranges.select(PART, *keys, F.count("*").over(earlier).alias("_earlier"), *(put[how](name).over(earlier).alias(name) for name, (_, how) in passed.items()))
    before = before.where("_earlier > 0").drop("_earlier").select(F.col(PART).alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *passed)
    same = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(before), same, "left").drop("_p", *(f"_k{i}" for i in range(len(keys))))  # at most a row for each range


def numbered(df: DataFrame, *order: str | Column, out: str = "rank", parts: int | None = None) -> DataFrame:
    """df with the place of each row in the whole order, from 1; rows that the order does not tell apart get any of theirs."""
    rows = ranged(df, *order, parts=parts).withColumn("_place", F.row_number().over(within([], *order)))
    counted = carry(rows, [], _before=(F.count("*"), "sum"))
    return counted.withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_place", "_before", PART)
