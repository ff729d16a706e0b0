"""Exact PERCENTILE_CONT / PERCENTILE_DISC per group without holding a group in one task.

Spark's ``percentile`` aggregate keeps every value of a group in the memory of one
task.  Here only counts are ordered:

1. one count per (group, value), a partial aggregation, so hot values collapse;
2. ``ranking.prefix_sums`` over the distinct values gives what lies before each; its slices
   are cut by rank, and cut again where too many values lie, so an outlier or a crowd of
   values in a narrow range changes no slice's size;
3. the values that hold a wanted rank are kept, at most three a group.

A NULL group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.ranking import ROWS_PER_SLICE, asc, prefix_sums


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value: str, p: float = 0.5,
                      cont: str = "percentile_cont", disc: str = "percentile_disc", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per group with PERCENTILE_CONT(p) (double) and PERCENTILE_DISC(p)
    (value type) over ``value`` (NULL values are ignored, as in SQL)."""
    keys = [f"_g{i}" for i in range(len(group_cols))]
    values = df.select(*[F.col(c).alias(k) for c, k in zip(group_cols, keys)], F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(counts, [asc("_v")], keys, {"_before": F.col("_c")}, {"_n": F.col("_c")}, rows_per_slice=rows_per_slice)
    place = 1 + (F.col("_n") - 1) * F.lit(float(p))

    def holds(rank: Column) -> Column:
        return (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_c"))

    low, high, least = holds(F.floor(place)), holds(F.ceil(place)), holds(F.greatest(F.ceil(F.col("_n") * F.lit(float(p))), F.lit(1)))
    picks = placed.where(low | high | least).groupBy(*keys).agg(
        F.max(F.when(low, F.col("_v").cast("double"))).alias("_low"), F.max(F.when(high, F.col("_v").cast("double"))).alias("_high"),
        F.max(F.when(least, F.col("_v"))).alias(disc), F.max(place - F.floor(place)).alias("_part"))
    return picks.select(*[F.col(k).alias(c) for c, k in zip(group_cols, keys)],
                        (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(cont), disc)
