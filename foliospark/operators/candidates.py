"""Choice among compression candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import saved_ratio

# Resolutions tried, from the highest.
DPI_LEVELS = [300, 250, 220, 200, 180, 160, 144, 130, 120, 110, 100, 90, 80, 72]


def best_candidate(jobs: DataFrame, candidates: DataFrame, same_format: bool = True) -> DataFrame:
    """Smallest candidate, first on ties; the original when its format stays and nothing is smaller."""
    best = candidates.groupBy("job").agg(F.min(F.struct("size", "ord", "method")).alias("b"))
    keep = F.col("b").isNull() | (F.lit(same_format) & (F.col("b.size") >= F.col("original_size")))
    out = jobs.join(best, "job", "left").select(
        "job", "original_size", F.when(keep, F.col("original_size")).otherwise(F.col("b.size")).alias("compressed_size"),
        F.when(keep, "original").otherwise(F.col("b.method")).alias("method"))
    return with_stats(out)


def with_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({"saved_bytes": F.col("original_size") - F.col("compressed_size"),
                           "compression_ratio": saved_ratio(F.col("original_size"), F.col("compressed_size"))})


def target_size(jobs: DataFrame, candidates: DataFrame, target: int) -> DataFrame:
    """Highest resolution that meets the target, else the smallest size (the higher dpi on ties)."""
    fits = F.col("size") <= target
    c = candidates.groupBy("job").agg(
        F.max(F.when(fits, F.struct("dpi", "size"))).alias("hit"),
        F.min(F.struct(F.col("size").alias("size"), (-F.col("dpi")).alias("neg_dpi"))).alias("least"))
    j = jobs.join(c, "job", "left")
    small = F.col("original_size") <= target
    return j.select("job", "original_size",
                    (small | F.col("hit").isNotNull()).alias("target_reached"),
                    F.when(small, 300).when(F.col("hit").isNotNull(), F.col("hit.dpi")).when(F.col("least").isNotNull(), -F.col("least.neg_dpi")).otherwise(30).alias("final_dpi"),
                    F.when(small, F.col("original_size")).when(F.col("hit").isNotNull(), F.col("hit.size")).otherwise(F.col("least.size")).alias("compressed_size"))
