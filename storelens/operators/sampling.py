"""Reproducible sampling operators.

The reference samples with NEWID()/RAND()/BINARY_CHECKSUM, which are not
reproducible.  Here randomness is an md5 digest of a seed and the row key,
which is deterministic (safe to recompute after a lost executor) and gives the
same digest in any SQL engine, so samples can be checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.semantics import seeded_key
from storelens.operators.ranking import Key, row_numbers, up_to_key

HASH_DIGITS = 6  # hex digits of the digest used as a uniform number


def hash_threshold(pct: float) -> str | None:
    """Hex text t such that ``substr(md5, 1, 6) < t`` holds for ``pct`` % of
    digests; None when every row qualifies (pct >= 100)."""
    n = round(max(0.0, pct) / 100.0 * 16 ** HASH_DIGITS)
    return None if n >= 16 ** HASH_DIGITS else format(n, f"0{HASH_DIGITS}x")


def hash_sample(df: DataFrame, key: str | Column, pct: float, seed: str) -> DataFrame:
    """About ``pct`` % of the rows, chosen by the digest of (seed, key): a filter, no shuffle."""
    t = hash_threshold(pct)
    return df if t is None else df.where(F.substring(seeded_key(seed, key), 1, HASH_DIGITS) < F.lit(t))


def top_percent(df: DataFrame, pct: float, order: Sequence[Key]) -> DataFrame:
    """TOP p PERCENT in ``order``: the first ceil(N * p / 100) rows, by selection of the last one's key."""
    return up_to_key(df, order, lambda total: math.ceil(total * pct / 100.0))


def every_kth(df: DataFrame, order: Sequence[Key], keep: Column, rn: str = "row_number") -> DataFrame:
    """Rows whose global row number (in ``order``) satisfies ``keep``
    (an expression over the column ``rn``)."""
    return row_numbers(df, order, rn=rn).where(keep)


def bottom_k(df: DataFrame, cls: Column, digest: Column, key: str, k: int, digits: int = 4) -> DataFrame:
    """The ``k`` rows of the smallest (``digest``, ``key``) of each class; ``digest`` is hex text, spread evenly.

    Rows are counted by class and the first ``digits`` of the digest, an aggregate that every task fills and
    Spark merges.  From these counts (16 ** digits a class at most) follows the prefix in which a class's
    ``k``-th row lies: rows of larger prefixes go, those of smaller ones are kept, and only inside a prefix,
    1 / 16 ** digits of a class, rows are put in order.  A null class is a class.
    """
    if k <= 0:
        return df.where(F.lit(False))
    rows = df.withColumns({"_c": cls, "_d": digest}).withColumn("_h", F.substring("_d", 1, digits))
    counts = rows.groupBy("_c", "_h").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_c").orderBy("_h")) - F.col("_n"))
    # the last prefix that begins before the k-th row (a smaller class's very last one)
    last = counts.where(F.col("_before") < k).groupBy(F.col("_c").alias("_lc")).agg(F.max(F.struct("_h", "_before")).alias("_last"))
    placed = rows.join(last, F.col("_c").eqNullSafe(F.col("_lc"))).where(F.col("_h") <= F.col("_last._h"))
    place = F.row_number().over(Window.partitionBy("_c", "_h").orderBy("_d", key))
    kept = placed.withColumn("_place", place).where((F.col("_h") < F.col("_last._h")) | (F.col("_place") <= k - F.col("_last._before")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def balanced_sample(df: DataFrame, cls: str | Column, k: int, seed: str, key: str) -> DataFrame:
    """At most ``k`` rows per class, the smallest in seeded random order; any ``k``, and no class is ever
    sorted (see :func:`bottom_k`)."""
    return bottom_k(df, F.col(cls) if isinstance(cls, str) else cls, seeded_key(seed, key), key, k)
