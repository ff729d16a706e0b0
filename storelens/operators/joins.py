"""Join shapes Spark does not plan well on its own at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that can be spread, counters kept for finding them, salts a shuffle partition.
HOT_KEYS, COUNTERS, SALTS = 256, 4096, 16


def full_outer_with_small(big: DataFrame, small: DataFrame, big_key: str, small_key: str) -> DataFrame:
    """``big FULL OUTER JOIN small ON big_key = small_key`` for a small right side.

    Spark can neither broadcast nor split skewed partitions of a full outer
    join, so a low-cardinality key would funnel the big side into a few tasks.
    Here: big LEFT JOIN small (broadcastable, skew-splittable) plus the small
    rows whose key never occurs in big (anti join against big's distinct keys,
    a partial aggregation).  NULL keys never match, as in the full join.
    """
    matched = big.join(small, big[big_key] == small[small_key], "left")
    keys = big.select(F.col(big_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    unmatched = small.join(keys, small[small_key] == F.col("_k"), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(df: DataFrame, on: Sequence[str]) -> Column:
    """The hashes of the keys that fill more than half a shuffle partition's share of ``df``: an array of at most
    ``HOT_KEYS`` longs as a scalar subquery, from a counter of bounded size that every task fills and Spark merges.
    A key that the counter does not surely know as frequent is missing: it is joined as any other."""
    hashed = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in on]).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {COUNTERS})").alias("t"), F.count(F.lit(1)).alias("n"))
    above = F.expr(f"transform(filter(t, x -> x.count * {2 * _partitions(df)} > n), x -> x.item)")
    return found.select(above).scalar()


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", null_safe: bool = False,
              hot: Column | None = None, salts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``: the left columns, then the right ones but the keys.

    Rows of ``left`` whose key is frequent are spread over salts by their other columns, and the rows of
    ``right`` with these keys get a copy for every salt; all others are joined as always.  ``hot`` holds the
    hashes of the frequent keys (:func:`frequent_keys` of ``left`` by default).  In a left join rows
    with a NULL key, which meet nothing, are spread as well.  ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: a right row may be copied only if left rows alone decide the result")
    hot = frequent_keys(left, on) if hot is None else hot
    salts = salts or SALTS * _partitions(left)
    keys = [F.col(f"`{c}`") for c in on]
    frequent = F.coalesce(F.array_contains(hot, F.xxhash64(*keys)), F.lit(False))
    spread = frequent
    if not null_safe and how != "inner":
        for k in keys:
            spread = spread | k.isNull()
    salt = F.pmod(F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(spread, salt).otherwise(0))
    every = F.when(frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.select(*[k.alias(f"_j{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in on],
                          F.explode(every).alias("_jsalt"))
    return _joined(salted, copies, on, how, null_safe, "_salt", "_jsalt", left, right)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """``left`` joined with a ``right`` of few rows a key, where all keys are few (say, states): every row of ``left``
    is spread by a salt and every row of ``right`` copied for each, so no task holds a whole key."""
    salts = salts or SALTS * _partitions(left)
    keys = [F.col(f"`{c}`") for c in on]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    copies = right.select(*[k.alias(f"_j{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in on],
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_jsalt"))
    return _joined(left.withColumn("_salt", salt), copies, on, how, False, "_salt", "_jsalt", left, right)


def _joined(a: DataFrame, b: DataFrame, on: Sequence[str], how: str, null_safe: bool, sa: str, sb: str, left: DataFrame, right: DataFrame) -> DataFrame:
    same = F.col(sa) == F.col(sb)
    for i, c in enumerate(on):
        same = same & (F.col(f"`{c}`").eqNullSafe(F.col(f"_j{i}")) if null_safe else F.col(f"`{c}`") == F.col(f"_j{i}"))
    more = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    return a.join(b, same, how).select(*[F.col(f"`{c}`") for c in [*left.columns, *more]])
