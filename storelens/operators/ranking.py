"""Numbering, ranks and top-n that do not pull a whole partition into one task.

``ROW_NUMBER() OVER (ORDER BY k)`` without PARTITION BY is planned by Spark as a
single-partition window: every row goes to one task.  ``prefix_sums`` spreads the work:

1. the rows are written once with their key tuple (group columns, then order keys);
2. splitters cut the key space into slices of about ``rows_per_slice`` rows.  They start
   from a share of the tuples chosen by hash, and are refined: each round counts the rows
   of every slice exactly, and slices that hold too many get more splitters from their own
   tuples.  A tuple is unique, so a hot value is cut like any other;
3. the splitters are one sorted array, a scalar subquery of the plan that every task gets
   once; a row's slice is a binary search in it.  The slice is a pure function of the row,
   so a recomputation after a lost executor places it identically;
4. sums per (slice, group) give, by a prefix sum over the slices, what lies before each;
5. a window inside (slice, group) adds what lies before a row in its slice.

``row_numbers`` is the prefix sum of ones.  ``ranks`` counts equal keys first, so ties
collapse, and takes one prefix sum of the counts and one of ones over the distinct keys.
``kth_key`` follows a rank through counted slices without numbering anything.

Order keys must end in a column that is unique within a group, as the
reference's tie-breaks require anyway.  Keys are given as ``asc(c)`` /
``desc(c)`` (SQL defaults: NULLS FIRST ascending, NULLS LAST descending).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators.joins import skew_join
from storelens.operators.storage import written

#: Rows a slice should hold; one splitter tuple is kept for so many rows.
ROWS_PER_SLICE = 1_000_000
#: Sampled tuples for a splitter, rounds of exact counts, and how far above its share a slice may be after them.
PER_SPLITTER, ROUNDS, SLACK = 8, 4, 2.0


@dataclass(frozen=True)
class Key:
    col: Column
    ascending: bool = True

    def order(self, c: Column | None = None) -> Column:
        c = self.col if c is None else c
        return c.asc() if self.ascending else c.desc()


def asc(c: str | Column) -> Key:
    return Key(F.col(c) if isinstance(c, str) else c, True)


def desc(c: str | Column) -> Key:
    return Key(F.col(c) if isinstance(c, str) else c, False)


def _at_or_after(keys: Sequence[Column], ups: Sequence[bool], other: Sequence[Column]) -> Column:
    """Key tuple >= the other one, in the sort order."""
    out = None
    for k, up, v in reversed(list(zip(keys, ups, other))):
        after = F.coalesce(k > v, k.isNotNull() & v.isNull()) if up else F.coalesce(k < v, k.isNull() & v.isNotNull())
        out = (after | k.eqNullSafe(v)) if out is None else (after | (k.eqNullSafe(v) & out))
    return out


class _Sliced:
    """The key tuples (columns _k0, _k1, ...) of a written table, cut by splitters."""

    def __init__(self, table: DataFrame, ups: Sequence[bool]) -> None:
        self.table, self.ups = table, list(ups)
        self.names = [f"_k{i}" for i in range(len(ups))]
        self.sort = [F.col(n).asc() if up else F.col(n).desc() for n, up in zip(self.names, ups)]
        self.splitters: list[tuple] = []

    def with_slice(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (the table) with _slice, how many splitters lie at or before the row's tuple: a binary search in
        the sorted array of splitters, which is a scalar subquery (one value a task, not a value of every row)."""
        rows = self.table if rows is None else rows
        n = len(self.splitters)
        if n == 0:
            return rows.withColumn("_slice", F.lit(0))
        fields = [self.table.schema[c] for c in self.names]
        kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in fields])))])
        held = self.table.sparkSession.createDataFrame([(self.splitters,)], kind).scalar()
        steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

        def step(state: Column, width: Column) -> Column:
            to = state["p"] + width
            there = F.get(state["a"], to - 1)
            go = (to <= n) & _at_or_after([F.col(c) for c in self.names], self.ups, [there[c] for c in self.names])
            return F.struct(F.when(go, to).otherwise(state["p"]).alias("p"), state["a"].alias("a"))

        found = F.aggregate(steps, F.struct(F.lit(0).alias("p"), F.col("_held").alias("a")), step, lambda state: state["p"])
        return rows.withColumn("_held", held).withColumn("_slice", found).drop("_held")

    def counts(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.with_slice().groupBy("_slice").agg(F.count(F.lit(1))).collect()}

    def sampled(self, rate: float, seed: int, heavy: Sequence[int] | None = None) -> list[tuple]:
        """Every ``PER_SPLITTER``-th of the sorted tuples whose hash falls under ``rate``: (slice, tuple).
        ``heavy``: only those of these slices."""
        rows = self.with_slice().select("_slice", *self.names)
        if heavy is not None:
            rows = rows.where(F.col("_slice").isin(list(heavy)))
        hashed = F.pmod(F.xxhash64(F.lit(seed), *self.names), F.lit(1 << 30)) < int(rate * (1 << 30))
        # the sort leaves sorted parts: the id counts inside each
        chosen = rows.where(hashed).orderBy(*self.sort).withColumn("_id", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        chosen = chosen.where(F.col("_id") % PER_SPLITTER == PER_SPLITTER - 1).drop("_id")
        return [(r[0], tuple(r)[1:]) for r in chosen.orderBy(*self.sort).collect()]

    def refine(self, total: int, slices: int) -> None:
        """Splitters for about ``slices`` slices, until none holds more than ``SLACK`` times its share."""
        slices = max(1, min(slices, total))
        share = total / slices
        rate = min(1.0, PER_SPLITTER / share) if slices > 1 else 0.0
        if rate:
            self.splitters = [t for _, t in self.sampled(rate, 17)]
        for seed in range(ROUNDS if rate else 0):
            heavy = [s for s, n in self.counts().items() if n > SLACK * share]
            if not heavy:
                break
            # twice the rate inside these slices, by another hash; a tuple that is a splitter already adds none
            more: dict[int, list[tuple]] = {}
            for s, t in self.sampled(min(1.0, 2 * PER_SPLITTER / share), seed, heavy):
                more.setdefault(s, []).append(t)
            before = [None, *self.splitters]
            old, self.splitters = self.splitters, []
            for s in range(len(old) + 1):
                self.splitters += [t for t in more.get(s, ()) if t != before[s]] + old[s:s + 1]


def _sliced(df: DataFrame, keys: Sequence[Key], num_slices: int | None, rows_per_slice: int) -> tuple[_Sliced, int]:
    """``df``, written with its key tuples, cut into slices; and its number of rows."""
    table = written(df.select("*", *[k.col.alias(f"_k{i}") for i, k in enumerate(keys)]))
    total = table.count()
    sliced = _Sliced(table, [k.ascending for k in keys])
    sliced.refine(total, num_slices or max(1, -(-total // rows_per_slice)))
    return sliced, total


def prefix_sums(df: DataFrame, order: Sequence[Key], partition_by: Sequence[str], sums: dict[str, Column],
                totals: dict[str, Column] | None = None, num_slices: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the earlier rows of the group (0 before
    the first), and for each name of ``totals`` the sum over the whole group.  Columns are not null."""
    keys = [asc(g) for g in partition_by] + list(order)
    totals = totals or {}
    sliced, _ = _sliced(df.select("*", *[c.alias(f"_v{i}") for i, c in enumerate([*sums.values(), *totals.values()])]), keys, num_slices, rows_per_slice)
    groups, values = sliced.names[:len(partition_by)], [f"_v{i}" for i in range(len(sums) + len(totals))]
    rows = sliced.with_slice()
    whole = Window.partitionBy("_slice", *groups)
    inside = whole.orderBy(*sliced.sort[len(partition_by):]).rowsBetween(Window.unboundedPreceding, 0)
    before = {v: F.sum(v).over(inside) - F.col(v) for v in values[:len(sums)]}
    own = [F.col(f"`{c}`") for c in df.columns]
    if not sliced.splitters:  # one slice: nothing lies before it
        return rows.select(*own, *[before[v].alias(n) for n, v in zip(sums, values)],
                           *[F.sum(v).over(whole).alias(n) for n, v in zip(totals, values[len(sums):])])
    parts = rows.groupBy("_slice", *groups).agg(*[F.sum(v).alias("_s" + v) for v in values])
    # a group has a row here for each slice it reaches into: rows / rows_per_slice of them
    upto = Window.partitionBy(*groups).orderBy("_slice")
    parts = parts.select(F.col("_slice").alias("_os"), *[F.col(g).alias("_o" + g) for g in groups],
                         *[(F.sum("_s" + v).over(upto) - F.col("_s" + v)).alias("_b" + v) for v in values[:len(sums)]],
                         *[F.sum("_s" + v).over(Window.partitionBy(*groups)).alias("_t" + v) for v in values[len(sums):]])
    rows = rows.select("*", *[e.alias("_l" + v) for v, e in before.items()])
    same = [F.col("_slice") == F.col("_os")] + [F.col(g).eqNullSafe(F.col("_o" + g)) for g in groups]
    out = rows.join(parts, same)
    return out.select(*own, *[(F.col("_b" + v) + F.col("_l" + v)).alias(n) for n, v in zip(sums, values)],
                      *[F.col("_t" + v).alias(n) for n, v in zip(totals, values[len(sums):])])


def row_numbers(df: DataFrame, order: Sequence[Key], partition_by: Sequence[str] = (),
                rn: str = "rn", size: str | None = None,
                num_slices: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``rn`` = ROW_NUMBER() OVER (PARTITION BY partition_by ORDER BY order);
    ``size`` (optional) = number of rows in the group."""
    one = F.lit(1).cast("long")
    out = prefix_sums(df, order, partition_by, {rn: one}, {size: one} if size else {}, num_slices, rows_per_slice)
    return out.withColumn(rn, F.col(rn) + 1)


def ranks(df: DataFrame, order: Sequence[Key], partition_by: Sequence[str] = (), rank: str | None = None, dense_rank: str | None = None,
          percent_rank: str | None = None, cume_dist: str | None = None, num_slices: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add the named ones of RANK, DENSE_RANK (long), PERCENT_RANK and CUME_DIST (double) OVER (PARTITION BY
    partition_by ORDER BY order).  Unlike row numbers they need no unique order; ties may be of any size."""
    names = [f"_r{i}" for i in range(len(partition_by) + len(order))]
    cols = [F.col(g) for g in partition_by] + [k.col for k in order]
    rows = written(df.select("*", *[c.alias(n) for c, n in zip(cols, names)]))
    groups, keys = names[:len(partition_by)], [Key(F.col(n), k.ascending) for n, k in zip(names[len(partition_by):], order)]
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))
    c, one = F.col("_c"), F.lit(1).cast("long")
    placed = prefix_sums(counted, keys, groups, {"_before": c, "_distinct": one}, {"_n": c}, num_slices, rows_per_slice)
    wanted = {rank: F.col("_before") + 1, dense_rank: F.col("_distinct") + 1,
              percent_rank: F.when(F.col("_n") > 1, F.col("_before") / (F.col("_n") - 1)).otherwise(F.lit(0.0)),
              cume_dist: (F.col("_before") + c) / F.col("_n")}
    wanted = {n: e for n, e in wanted.items() if n}
    # a value that very many rows share is a hot key of this join: the counts tell which
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = placed.where(c * 2 * parts > placed.agg(F.sum("_c")).scalar()).agg(F.collect_list(F.xxhash64(*names))).scalar()
    placed = placed.select(*names, *[e.alias(n) for n, e in wanted.items()])
    return skew_join(rows, placed, names, null_safe=True, hot=often).select(*[F.col(f"`{x}`") for x in df.columns], *wanted)


def kth_key(df: DataFrame, order: Sequence[Key], k: int | Callable[[int], int], few: int = 10_000, num_slices: int = 256) -> tuple[DataFrame, tuple | None]:
    """``df``, written with its key tuples _k0, _k1, ..., and the ``k``-th tuple in ``order`` (the last one if there are
    fewer rows; None for no row).  ``k`` may be a function of the number of rows.

    The rows that can hold it are cut into slices and counted; the slice of the wanted rank is taken for the next
    round, until it holds at most ``few`` tuples."""
    sliced, total = _sliced(df, order, 1, ROWS_PER_SLICE)
    k = min(k(total) if callable(k) else k, total)
    if k < 1:
        return sliced.table, None
    left, here = sliced.table.select(*sliced.names), total
    while here > few:
        part = _Sliced(left, sliced.ups)
        part.refine(here, num_slices)
        for s, n in sorted(part.counts().items()):
            if k <= n:
                break
            k -= n
        if n < here:
            left, here = part.with_slice().where(F.col("_slice") == s).drop("_slice"), n
            continue
        # one tuple fills the slice: the wanted one, or it goes
        least = tuple(left.orderBy(*sliced.sort).limit(1).first())
        equal = F.lit(True)
        for c, v in zip(sliced.names, least):
            equal = equal & F.col(c).eqNullSafe(F.lit(v).cast(sliced.table.schema[c].dataType))
        n = left.where(equal).count()
        if k <= n:
            return sliced.table, least
        left, here, k = left.where(~equal), here - n, k - n
    return sliced.table, tuple(left.orderBy(*sliced.sort).limit(k).collect()[-1])


def up_to_key(df: DataFrame, order: Sequence[Key], k: int | Callable[[int], int], few: int = 10_000, num_slices: int = 256) -> DataFrame:
    """The first ``k`` rows in ``order``: one filter by the k-th key, no row is numbered."""
    table, key = kth_key(df, order, k, few, num_slices)
    kept = F.lit(False)
    if key is not None:
        last = [F.lit(v).cast(table.schema[f"_k{i}"].dataType) for i, v in enumerate(key)]
        kept = _at_or_after(last, [o.ascending for o in order], [F.col(f"_k{i}") for i in range(len(order))])
    return table.where(kept).select(*[F.col(f"`{c}`") for c in df.columns])


def ntile_of(rn: Column, size: Column, k: int) -> Column:
    """NTILE(k) from a 1-based row number and the group size (SQL semantics:
    the first ``size % k`` tiles hold one row more)."""
    q = (size / k).cast("bigint")
    m = size % k
    big = m * (q + 1)
    first = ((rn - 1) / (q + 1)).cast("bigint") + 1
    rest = m + ((rn - big - 1) / F.nullif(q, F.lit(0))).cast("bigint") + 1
    return F.when(rn <= big, first).otherwise(rest)


def ntile(df: DataFrame, k: int, order: Sequence[Key], partition_by: Sequence[str] = (),
          name: str = "ntile") -> DataFrame:
    numbered = row_numbers(df, order, partition_by, rn="_rn", size="_size")
    return numbered.withColumn(name, ntile_of(F.col("_rn"), F.col("_size"), k)).drop("_rn", "_size")


def top_n(df: DataFrame, n: int, order: Sequence[Key]) -> DataFrame:
    """Global top-n: each task keeps its own n best rows, the driver merges them
    (TakeOrderedAndProject); ``order`` should end in a unique key."""
    return df.orderBy(*[o.order() for o in order]).limit(n)


def mode_by_key(df: DataFrame, key: Sequence[str], label: str, weight: Column | None = None,
                ties: str = "first") -> DataFrame:
    """Most frequent ``label`` per ``key``.

    ``ties='first'`` keeps one label per key (smallest label among equal
    counts, i.e. ROW_NUMBER = 1 with the label as tie-break); ``ties='all'``
    keeps every label with the top count (RANK = 1).  Counting is a partial
    aggregation, so a hot key never has its rows in one task.
    """
    cnt = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*key, label).agg(cnt.alias("_cnt"))
    if ties == "first":
        best = counted.groupBy(*key).agg(F.min(F.struct(F.negative("_cnt").alias("n"), F.col(label).alias("l")))
                                          .alias("_b"))
        return best.select(*key, F.col("_b.l").alias(label), F.negative("_b.n").alias("_cnt"))
    w = Window.partitionBy(*key).orderBy(F.desc("_cnt"))
    return counted.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") == 1).drop("_rk")


def top_k_per_group(df: DataFrame, group: Sequence[str | Column], order: Sequence[Key], k: int,
                    rn: str | None = None) -> DataFrame:
    """Rows with ROW_NUMBER() OVER (PARTITION BY group ORDER BY order) <= k.

    Up to Spark's group-limit threshold the window filter is planned with a
    partial WindowGroupLimit (each task keeps k rows per group before the
    shuffle).  Above it Spark would sort whole groups in one task, so the
    sliced numbering is used instead."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    name = rn or "_rn"
    if 0 < k <= limit:
        w = Window.partitionBy(*group).orderBy(*[o.order() for o in order])
        out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    else:
        cols = []
        for i, g in enumerate(group):
            if isinstance(g, str):
                cols.append(g)
            else:
                df = df.withColumn(f"_grp{i}", g)
                cols.append(f"_grp{i}")
        out = row_numbers(df, order, partition_by=cols, rn=name).where(F.col(name) <= k)
        out = out.drop(*[c for c in cols if c.startswith("_grp")])
    return out if rn else out.drop(name)
