"""Global ordinals and running values without a single-task window.

Rows go to ranges of (sort key, tie), cut at sampled quantiles, as many as their number asks for; within a range a window works as usual, and each range's total,
a row a range, is carried to the ranges after it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range, most ranges, and sampled rows of a range.
ROWS, MOST, SAMPLED = 1 << 18, 1 << 12, 32


def _cuts(df: DataFrame, key: str, tie: str, ranges: int | None) -> list[tuple]:
    n = df.count()
    ranges = min(MOST, ranges or -(-n // ROWS))
    if ranges < 2 or not n:
        return []
    drawn = sorted(map(tuple, df.select(key, tie).sample(min(1.0, SAMPLED * ranges / n), seed=1).collect()))
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def _array(values: list) -> Column:
    return F.lit(np.array(values)) if isinstance(values[0], int | float) else F.array(*map(F.lit, values))


def _range(key: str, tie: str, cuts: list[tuple]) -> Column:
    """How many cuts are at or below (key, tie): a binary search."""
    keys, ties = (_array(list(x)) for x in zip(*cuts))
    halves = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def further(at, s):
        k, t = F.get(keys, at + s - 1), F.get(ties, at + s - 1)
        below = (k < F.col(key)) | ((k == F.col(key)) & (t <= F.col(tie)))
        return F.when((at + s <= len(cuts)) & below, at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), further)


def ordinals(df: DataFrame, key: str, tie: str, name: str = "ord", ranges: int | None = None) -> DataFrame:
    """df with the place (from 0) of each row in the order of (key, tie); neither is null. The number of ranges follows the rows unless it is given."""
    cuts = _cuts(df, key, tie, ranges)
    placed = df.withColumn("_range", _range(key, tie, cuts) if cuts else F.lit(0))
    within = (F.row_number().over(Window.partitionBy("_range").orderBy(key, tie)) - 1).cast("bigint")
    if not cuts:
        return placed.withColumn(name, within).drop("_range")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # before: a row a range, MOST at most
    return placed.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(name, F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def neighbours(df: DataFrame, ordinal: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """df with the columns of the row before by an ordinal without gaps (null for the first): an equi-join."""
    before = df.select((F.col(ordinal) + 1).alias(ordinal), *(F.col(c).alias(prefix + c) for c in columns))
    return df.join(before, ordinal, "left")


def running_sums(df: DataFrame, ordinal: str, columns: list[str], block: int = 4096) -> DataFrame:
    """df with inclusive running sums of the columns along an ordinal: within blocks, plus the sums of earlier blocks."""
    blocked = df.withColumn("_block", F.floor(F.col(ordinal) / block))
    totals = blocked.groupBy("_block").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_block", *(F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_c_{c}") for c in columns))
    inside = Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.select("*", *(F.sum(c).over(inside).alias(f"_i_{c}") for c in columns)).join(carried, "_block")
    return out.select(*df.columns, *((F.col(f"_i_{c}") + F.col(f"_c_{c}")).cast("bigint").alias(f"sum_{c}") for c in columns))
