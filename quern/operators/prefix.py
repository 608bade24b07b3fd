"""Running sums and ranks over groups of any size.

A window over a group runs in one task. Here a group is cut into ranges of its order column, the
ranges' totals (few rows) are summed up, and each range is then a window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: list[str], part: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    ``part`` is an integer that never falls as ``order`` grows (a range of the order column); it
    should cut groups into parts that fit a task. Rows with a NULL value add nothing.
    """
    if not group:  # one group of all rows
        return running_sum(df.withColumn("_all", F.lit(0)), ["_all"], order, part, value, out).drop("_all")
    src = df.withColumn("_part", part).withColumn("_v", F.coalesce(value, F.lit(0)).cast("bigint"))
    totals = src.groupBy(*group, "_part").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*group, "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out_df = src.withColumn("_in", F.coalesce(inside, F.lit(0)))
    keep = [c for c in df.columns if c not in group]
    return out_df.join(before, [*group, "_part"]).select(*group, *keep, (F.col("_before") + F.col("_in")).alias(out))
