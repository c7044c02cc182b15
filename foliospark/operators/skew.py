"""Window forms that survive a key holding a large share of all rows.

A plain window puts every row of a key in one task. The forms here cut each key into buckets
along its order column (an hour, a block of positions), work inside the buckets in parallel,
and carry only one summary row per bucket across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str,
                 out: str) -> DataFrame:
    """``lag(value)`` per key in the given order; ``bucket`` must grow with the order."""
    d = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    rank = F.row_number().over(inside)
    d = d.withColumn("_first", rank == 1).withColumn(out, F.lag(value).over(inside))
    last = df.withColumn("_b", bucket).groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_b")
    carry = last.select(*keys, "_b", F.lag("_last").over(across).alias("_carry"))
    joined = d.join(carry, [*keys, "_b"], "left")
    return (joined.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out)))
            .drop("_b", "_first", "_carry"))


def bucketed_row_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """``row_number`` per key; counts per bucket are summed first, ranks are taken inside buckets."""
    d = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    sizes = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (d.withColumn(out, F.row_number().over(inside)).join(starts, [*keys, "_b"])
            .withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_b", "_before"))


def running_counts(df: DataFrame, keys: list[str], second: str, tie: str,
                   periods: dict[str, int]) -> DataFrame:
    """Count of rows so far, the row included, in its aligned period, for several periods.

    Rows are first counted per key and second. Sums over seconds then run over at most one row
    per second, and only rows of one second are ever sorted together.
    """
    per_second = df.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("_n"))
    longest = max(periods.values())
    cols = [*keys, second]
    d = per_second.withColumn("_long", F.floor(F.col(second) / longest))
    for out, length in periods.items():
        if length == 1:
            d = d.withColumn(f"_{out}", F.lit(0).cast("long"))
            continue
        w = (Window.partitionBy(*keys, "_long", F.floor(F.col(second) / length)).orderBy(second)
             .rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn(f"_{out}", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    base = d.select(*cols, *[f"_{o}" for o in periods])
    rank = F.row_number().over(Window.partitionBy(*cols).orderBy(tie))
    joined = df.withColumn("_r", rank).join(base, cols)
    for out in periods:
        joined = joined.withColumn(out, (F.col("_r") + F.col(f"_{out}")).cast("long"))
    return joined.drop("_r", *[f"_{o}" for o in periods])
