"""Places and running sums in an order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of the order, each sorted, with the range's number _part and the row's place in it, _in; kept on
    disk, so that all who read it see one division."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_in", F.monotonically_increasing_id())
    out = out.withColumn("_part", F.shiftrightunsigned("_in", 33)).withColumn("_in", F.col("_in").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.persist(StorageLevel.DISK_ONLY)


def starts(parts: DataFrame, amount, *group: str) -> DataFrame:
    """For each range _p (and group) the sum of the amount in the ranges before it, _start; one row each."""
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    over = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy(F.col("_part").alias("_p"), *keys).agg(amount.alias("_n"))
    return each.withColumn("_start", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in the order, from 0."""
    parts = ranged(df, *order)
    out = parts.join(F.broadcast(starts(parts, F.count("*"))), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_p", "_in", "_start")
