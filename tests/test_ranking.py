"""Slices, ranks, selection, percentiles and spread joins against Spark's own windows and joins."""

import random
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.operators.joins import frequent_keys, skew_join, spread_join
from storelens.operators.percentiles import exact_percentiles
from storelens.operators.ranking import _sliced, asc, desc, kth_key, prefix_sums, ranks, row_numbers, up_to_key
from storelens.operators.sampling import balanced_sample, top_percent


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def plain_joins(spark):
    """No adaptive execution and no broadcasts: what a plan does by itself."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_more_than_256_slices_equal_the_window(spark):
    rnd = random.Random(1)
    # one value holds a third of the rows, one far outlier, nulls
    data = [(i, rnd.choice([0.5] * 4 + [None, rnd.random(), rnd.random(), 1e9 * (i == 7)])) for i in range(12_000)]
    df = spark.createDataFrame(data, "id long, v double")
    got = row_numbers(df, [desc("v"), asc("id")], size="n", num_slices=400)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("v"), "id")).cast("long")).withColumn("n", F.lit(12_000))
    assert _rows(got) == _rows(want)


def test_slices_are_even_after_exact_counts(spark):
    data = [(i, 3.0 if i % 3 else (1e9 if i == 3 else i / 1e6)) for i in range(20_000)]
    sliced, total = _sliced(spark.createDataFrame(data, "id long, v double"), [asc("v"), asc("id")], 100, 1)
    counts = sliced.counts()
    assert total == 20_000 and sum(counts.values()) == total
    assert len(counts) > 60 and max(counts.values()) <= 2 * total / 100
    assert len(set(sliced.splitters)) == len(sliced.splitters)


def test_input_is_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(5000).mapInArrow(touch, "id long")
    assert row_numbers(df, [desc("id")], num_slices=40).count() == 5000
    assert reads.value == 5000


def test_prefix_sums(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice("ab"), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string, n long")
    got = prefix_sums(df, [asc("id")], ["g"], {"before": F.col("n")}, {"all": F.col("n")}, num_slices=30)
    w = Window.partitionBy("g")
    want = df.withColumn("before", F.sum("n").over(w.orderBy("id")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    assert _rows(got) == _rows(want)


tied = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, 1, 1, 1, 2, None]), st.sampled_from(["x", "y", None])), max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=tied, slices=st.integers(1, 12))
def test_ranks_equal_windows(spark, data, slices):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, g string, v long, s string")
    got = ranks(df, [desc("v"), asc("s")], ["g"], "r", "d", "p", "c", num_slices=slices)
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("s"))
    want = df.select("*", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"),
                     F.percent_rank().over(w).alias("p"), F.cume_dist().over(w).alias("c"))
    assert _rows(got) == _rows(want)


def test_ranks_with_a_value_of_most_rows(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 1000).alias("v"))
    got = ranks(df, [asc("v")], rank="r", cume_dist="c", num_slices=20)
    w = Window.orderBy("v")
    assert _rows(got) == _rows(df.select("*", F.rank().over(w).cast("long").alias("r"), F.cume_dist().over(w).alias("c")))


@pytest.mark.parametrize("pct", [0, 0.01, 33.3, 50, 100])
def test_top_percent_by_selection(spark, pct):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.choice(["k", "k", None, str(rnd.random())])) for i in range(3000)], "id long, v string")
    got = _rows(top_percent(df, pct, [desc("v"), asc("id")]))
    w = Window.orderBy(F.desc("v"), "id")
    want = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.ceil(F.lit(3000 * pct / 100))).drop("rn")
    assert got == _rows(want)


def test_selection_follows_counts(spark):
    rnd = random.Random(9)
    values = [rnd.choice([7, 7, 7, rnd.randint(0, 10 ** 6)]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    for k in (1, 17, 1000, 2500, 4000):  # equal rows fill whole slices
        assert kth_key(df, [asc("v")], k, few=50, num_slices=16)[1] == (sorted(values)[k - 1],)
    assert kth_key(df, [asc("v")], 0)[1] is None and kth_key(df, [asc("v")], 4001)[1] == (max(values),)
    top = up_to_key(df.withColumn("id", F.monotonically_increasing_id()), [asc("v"), asc("id")], 1234, few=20, num_slices=8)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 1234 and "Window" not in plan


def test_percentiles_with_an_outlier(spark):
    data = [(g, (1e9 if i == 0 else i / 1e4) * (1 if g else -1)) for g in (0, 1) for i in range(4000)] + [(2, 1.0)] * 3000
    df = spark.createDataFrame(data, "g long, v double")
    got = {r.g: (r.percentile_cont, r.percentile_disc) for r in exact_percentiles(df, ["g"], "v", 0.3, rows_per_slice=200).collect()}
    want = {r.g: (r.c, r.d) for r in df.groupBy("g").agg(
        F.percentile("v", 0.3).alias("c"), F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY v)").alias("d")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    # the slices of the distinct values: none has more than a bounded share of a group
    sliced, total = _sliced(df.distinct(), [asc("g"), asc("v")], None, 200)
    assert max(sliced.counts().values()) <= 400 and total == 8001


def _sides(spark):
    left = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, None).otherwise(F.col("id") % 5000).alias("k"))
    right = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).where("k % 7 != 3")
    return left, right.unionByName(right.where("k = 0").withColumn("w", F.lit(-1).cast("long")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, plain_joins, how):
    left, right = _sides(spark)
    assert [r[0] for r in spark.range(1).select(F.size(frequent_keys(left, ["k"]))).collect()] == [1]
    got, want = skew_join(left, right, ["k"], how), left.join(right, "k", how).select("id", "k", *(["w"] if how in ("inner", "left") else []))
    assert _rows(got) == _rows(want)
    if how != "left_anti":  # nothing frequent is left there
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in want.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * median(sizes) < max(plain)


def test_skew_join_null_safe_and_names(spark):
    a = spark.createDataFrame([(1, None), (2, "x")] * 20, "id long, k string")
    b = spark.createDataFrame([(None, 5), ("x", 6), ("y", 7)], "k string, `w x` long")
    assert _rows(skew_join(a, b, ["k"], null_safe=True)) == sorted([(1, None, 5), (2, "x", 6)] * 20, key=str)
    with pytest.raises(ValueError):
        skew_join(a, b, ["k"], "right")


def test_spread_join_equals_join(spark, plain_joins):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3).alias("k"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, w string")
    got = spread_join(left, right, ["k"], "left")
    assert _rows(got) == _rows(left.join(right, "k", "left").select("id", "k", "w"))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * median(sizes)


@pytest.mark.parametrize("k", [0, 1, 50, 100_000])
def test_balanced_sample_equals_the_window(spark, k):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 1000 == 1, None).otherwise("b").alias("c"))
    got = balanced_sample(df, "c", k, "s", "id")
    w = Window.partitionBy("c").orderBy(F.md5(F.concat(F.lit("s|"), F.col("id").cast("string"))), "id")
    assert _rows(got) == _rows(df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn"))
