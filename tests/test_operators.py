"""Operators against brute force on small inputs, and scalar edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.functions import geo
from storelens.functions.semantics import int_avg, is_blank_len, price_band, safe_ratio, year_diff
from storelens.operators.percentiles import exact_percentiles
from storelens.operators.ranking import asc, desc, mode_by_key, ntile, row_numbers
from storelens.operators.sampling import balanced_sample, hash_sample, hash_threshold
from storelens.operators.spatial import pairs_within
from storelens.plans.quality import not_in


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_row_numbers_equal_window(spark, slices):
    rnd = random.Random(slices)
    data = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, v long")
    order = [desc("v"), asc("id")]
    got = row_numbers(df, order, num_slices=slices)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("v"), F.asc("id"))))
    assert _rows(got, "id", "rn") == _rows(want, "id", "rn")
    got = row_numbers(df, order, partition_by=["g"], size="n", num_slices=slices)
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))
    want = (df.withColumn("rn", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g"))))
    assert _rows(got, "id", "rn", "n") == _rows(want, "id", "rn", "n")


@pytest.mark.parametrize("k,n", [(4, 3), (4, 17), (10, 100), (10, 7), (3, 1)])
def test_ntile_equals_window(spark, k, n):
    df = spark.createDataFrame([(i, i % 5) for i in range(n)], "id long, v long")
    got = ntile(df, k, [desc("v"), asc("id")], name="t")
    want = df.withColumn("t", F.ntile(k).over(Window.orderBy(F.desc("v"), F.asc("id"))))
    assert _rows(got, "id", "t") == _rows(want, "id", "t")
    sizes = [r[0] for r in got.groupBy("t").count().select("count").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_exact_percentiles_with_hot_values(spark):
    rnd = random.Random(7)
    data = []
    for g in range(4):
        n = [1, 2, 501, 3000][g]
        for i in range(n):
            # a third of group 3 holds one value
            v = 42.0 if (g == 3 and i % 3 == 0) else round(rnd.uniform(0, 1000), 2)
            data.append((g, v))
    df = spark.createDataFrame(data, "g long, v double")
    got = exact_percentiles(df, ["g"], "v", 0.5)
    want = df.groupBy("g").agg(F.percentile("v", 0.5).alias("percentile_cont"),
                               F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("percentile_disc"))
    g = {r.g: (r.percentile_cont, r.percentile_disc) for r in got.collect()}
    w = {r.g: (r.percentile_cont, r.percentile_disc) for r in want.collect()}
    assert g.keys() == w.keys()
    for key in g:
        assert math.isclose(g[key][0], w[key][0], rel_tol=1e-12)
        assert g[key][1] == w[key][1]


def test_mode_by_key_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "c")], "k long, l string")
    first = _rows(mode_by_key(df, ["k"], "l"), "k", "l")
    assert first == [(1, "a"), (2, "c")]
    all_ = _rows(mode_by_key(df, ["k"], "l", ties="all"), "k", "l")
    assert all_ == [(1, "a"), (1, "b"), (2, "c")]


def test_pairs_within_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(1500)]
    # centres near the antimeridian, near the pole and in the middle; plus dense points around them
    centres = [(0, 10.0, 179.9), (1, 88.5, 20.0), (2, 37.0, -92.5)]
    for cid, la, lo in centres:
        for j in range(60):
            pts.append((10000 + cid * 100 + j, la + rnd.uniform(-1.5, 1.5),
                        ((lo + rnd.uniform(-3, 3) + 180) % 360) - 180))
    p = spark.createDataFrame(pts, "id long, Latitude double, Longitude double")
    c = spark.createDataFrame(centres, "cid long, Latitude double, Longitude double")
    for metric in ("sphere", "ellipsoid"):
        got = _rows(pairs_within(p, c, 100.0, metric), "id", "c_cid")
        cross = p.crossJoin(c.select(*[F.col(x).alias("c_" + x) for x in c.columns]))
        d = geo.distance_miles(metric, F.col("Latitude"), F.col("Longitude"), F.col("c_Latitude"),
                               F.col("c_Longitude"))
        want = _rows(cross.where(d < 100.0), "id", "c_cid")
        assert got == want and len(want) > 50


def _town(seed=5):
    """90 % of the points in one town, a third of those at one spot, the others round the globe."""
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(400)]
    pts += [(1000 + i, 41.0 + rnd.gauss(0, 0.05), -87.0 + rnd.gauss(0, 0.05)) for i in range(2400)]
    pts += [(5000 + i, 41.0, -87.0) for i in range(1200)]
    return pts + [(9000, None, 3.0), (9001, 10.0, None), (9002, 0.0, 180.0), (9003, 90.0, 10.0)]


def test_dense_cells_are_split_and_equal_brute_force(spark):
    p = spark.createDataFrame(_town(), "id long, Latitude double, Longitude double").repartition(4)
    centres = [(0, 41.0, -87.0), (1, 41.08, -87.02), (2, 40.2, -87.9), (3, 0.0, -179.9), (4, 89.9, 100.0), (5, 41.0, 20.0)]
    c = spark.createDataFrame(centres, "cid long, Latitude double, Longitude double")
    cross = p.crossJoin(c.select(*[F.col(x).alias("c_" + x) for x in c.columns]))
    d = geo.distance_miles("sphere", F.col("Latitude"), F.col("Longitude"), F.col("c_Latitude"), F.col("c_Longitude"))
    for miles in (3.0, 60.0):
        want = _rows(cross.where(d < miles), "id", "c_cid")
        assert len(want) > 1000
        for dense in (50, 700, 10 ** 6):
            assert _rows(pairs_within(p, c, miles, dense=dense), "id", "c_cid") == want


def test_a_town_makes_even_keys(spark):
    from storelens.operators.spatial import keyed

    p = spark.createDataFrame(_town(), "id long, Latitude double, Longitude double")
    c = spark.createDataFrame([(0, 41.0, -87.0), (1, 41.0, 20.0)], "cid long, Latitude double, Longitude double")
    points, centres = keyed(p, c, 60.0, dense=100)
    sizes = [r["count"] for r in points.where("Latitude is not null and Longitude is not null").groupBy("_depth", "_node", "_salt").count().collect()]
    assert sum(sizes) == 4002 and max(sizes) <= 200  # salts deal by hash, so a little above 100
    # a centre far from the town meets none of its leaves
    assert centres.where("c_cid = 1 and _depth > 0").count() == 0 < centres.where("c_cid = 0 and _depth > 0").count()


def test_sphere_and_ellipsoid_agree_within_one_percent(spark):
    df = spark.createDataFrame([(30.0, -90.0, 31.0, -91.0), (45.0, -120.0, 40.0, -75.0),
                                (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    r = df.select(geo.great_circle_miles(*cols).alias("s"), geo.ellipsoid_miles(*cols).alias("e")).collect()
    for row in r:
        assert abs(row.s - row.e) / row.s < 0.01
    one_deg = df.select(geo.ellipsoid_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e")).first().e
    # one degree of longitude on the equator: a * pi / 180 feet
    assert math.isclose(one_deg, geo.ELLIPSOID_A_FEET * math.pi / 180 / 5280, rel_tol=1e-9)


def test_scalar_edges(spark):
    df = spark.createDataFrame([(1, 0, " ", dt.date(2000, 12, 31), dt.date(2001, 1, 1), 5.0),
                                (3, 2, "F  ", dt.date(2001, 1, 1), dt.date(2001, 12, 31), 10001.0)],
                               "a long, b long, g string, s date, e date, p double")
    r = df.select(safe_ratio("a", "b").alias("q"), is_blank_len("g").alias("len"),
                  year_diff("s", "e").alias("yd"),
                  price_band("p", [0, 10, 100], ["Free", "U10", "U100"]).alias("band")).collect()
    assert r[0].q is None and r[1].q == 1.5
    assert r[0].len == 0 and r[1].len == 1
    assert r[0].yd == 1 and r[1].yd == 0
    assert r[0].band == "U10" and r[1].band is None
    avg = spark.createDataFrame([(1,), (2,)], "x long").agg(int_avg("x").alias("m")).first().m
    assert avg == 1
    neg = spark.createDataFrame([(-1,), (-2,)], "x long").agg(int_avg("x").alias("m")).first().m
    assert neg == -1


def test_integer_average_of_many_rows(spark):
    # the exact average 1.9999997 truncates to 1
    n = 3_000_000
    df = spark.range(n).select(F.when(F.col("id") < n - 1, 2).otherwise(1).cast("long").alias("x"))
    assert df.agg(int_avg("x").alias("m")).first().m == 1


@pytest.mark.parametrize("rows", [["25000000.00", "25000000.01", "25000000.02"] * 100, ["31415926.00", "31415926.01", "31415926.02"] * 100 + ["31415926.00"]])
def test_variance_of_close_values(spark, rows):
    import datetime as dt
    import statistics
    from decimal import Decimal

    from storelens.plans import windows

    class Subscribers:
        subscribers = spark.createDataFrame([(i, "p", Decimal(v), dt.date(2000, 1, 1)) for i, v in enumerate(rows)],
                                            "SubscriberId long, RatePlan string, MonthlyFee decimal(12,2), StartDate date")

    got = windows.fee_dispersion_by_plan(Subscribers).first()
    want = statistics.stdev(map(Decimal, rows))
    assert abs(got.stdev_fee - float(want)) < 0.006 and abs(got.var_fee - float(want) ** 2) < 0.006 and got.var_fee >= 0


def test_not_in_empty_list_keeps_nulls(spark):
    left = spark.createDataFrame([(1,), (None,)], "k long")
    assert not_in(left, "k", left.limit(0), "k").count() == 2


def test_dates_outside_the_calendar_go(spark, tables):
    import datetime as dt
    rows = [(1, dt.date(1999, 1, 30)), (2, dt.date(1999, 1, 31)), (3, None), (4, dt.date(2050, 1, 1))]
    df = spark.createDataFrame(rows, "id long, d date")
    assert [r.id for r in tables.on_calendar(df, "d").collect()] == [1]


def test_null_price_is_not_high(spark):
    import datetime as dt
    from decimal import Decimal

    from storelens.plans import classify

    class Orders:
        orders = spark.createDataFrame([(1, 1, None, "AE", dt.date(1999, 1, 1)), (2, 1, Decimal(5), "AE", dt.date(1999, 1, 1))],
                                       "OrderId long, CampaignId long, TotalPrice decimal(12,2), PaymentType string, OrderDate date")

        @staticmethod
        def dimension(name, *cols):
            return spark.createDataFrame([(1, "WEB")], "CampaignId long, Channel string")

    r = classify.high_order_probability(Orders, 1999, 100.0).first()
    assert (r.n_high, r.n_not_high, r.high_probability) == (0, 2, 0.0)


def test_radius_zero_finds_nothing(spark):
    from storelens.operators.spatial import pairs_within
    df = spark.createDataFrame([(1.0, 2.0)], "Latitude double, Longitude double")
    assert pairs_within(df, df, 0).count() == 0 and pairs_within(df, df, 1).count() == 1


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1,)], "k long")
    assert _rows(not_in(left, "k", right, "k"), "k") == [(2,)]
    right_null = spark.createDataFrame([(1,), (None,)], "k long")
    assert not_in(left, "k", right_null, "k").count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(2000)], "id long, c long")
    n = hash_sample(df, "id", 10.0, "s").count()
    assert 120 < n < 280
    assert hash_threshold(100) is None and hash_sample(df, "id", 100.0, "s").count() == 2000
    assert hash_threshold(0) == "000000" and hash_sample(df, "id", 0.0, "s").count() == 0
    b = balanced_sample(df, "c", 50, "s", "id")
    assert sorted(r[1] for r in b.groupBy("c").count().collect()) == [50, 50]


@pytest.mark.parametrize("per_slice", [20, 90, 4096])
def test_exact_percentiles_null_group_and_slices(spark, per_slice):
    rnd = random.Random(11)
    rows = [(g, float(rnd.randint(0, 99))) for g in (0, 1, None) for _ in range(200)] + [(5, 3.0)] * 50 + [(6, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: (r.percentile_cont, r.percentile_disc) for r in exact_percentiles(df, ["g"], "v", rows_per_slice=per_slice).collect()}
    want = {r.g: (r.c, r.d) for r in df.where("v is not null").groupBy("g").agg(
        F.percentile("v", 0.5).alias("c"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("d")).collect()}
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_top_k_per_group_both_paths(spark, k):
    from storelens.operators.ranking import top_k_per_group
    rnd = random.Random(k)
    df = spark.createDataFrame([(i, rnd.choice("abc"), rnd.randint(0, 9)) for i in range(200)], "id long, g string, v long")
    order = [desc("v"), asc("id")]
    want = _rows(top_k_per_group(df, ["g"], order, k), "id")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1")
    try:
        got = _rows(top_k_per_group(df, ["g"], order, k), "id")
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert got == want and len(got) == 3 * k


def test_full_outer_with_small_equals_full_join(spark):
    from storelens.operators.joins import full_outer_with_small
    big = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(300)], "id long, bk long")
    small = spark.createDataFrame([(k, f"s{k}") for k in (None, 0, 3, 6, 9, 12)], "sk long, label string")
    got = _rows(full_outer_with_small(big, small, "bk", "sk"), "id", "bk", "sk", "label")
    want = _rows(big.join(small, big.bk == small.sk, "full"), "id", "bk", "sk", "label")
    assert got == want


def test_median_approx_close_to_exact(tables):
    from storelens.plans import windows
    ex = {(r.year, r.month): r.percentile_disc for r in windows.median_order_by_month(tables).collect()}
    ap = {(r.year, r.month): r.percentile_disc for r in windows.median_order_by_month(tables, approx=True).collect()}
    # groups far below the sketch's accuracy: its rank error is under one row
    assert ex == ap


def test_distinct_counts_merge(spark):
    from storelens.operators.distinct import count_distinct, id_sets, merged, set_sizes
    rnd = random.Random(6)
    rows = [(rnd.choice("abc"), rnd.randint(1, 3), rnd.choice([None, -1, -64, 2 ** 40, *range(60, 70), *range(500)])) for _ in range(5000)]
    rows += [("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, h long, id long")
    want = df.groupBy("g", "h").agg(F.countDistinct("id").alias("n"))
    sets = id_sets(df, ["g", "h"], "id")
    assert _rows(set_sizes(sets, ["g", "h"], "n"), "g", "h", "n") == _rows(want, "g", "h", "n")
    assert _rows(set_sizes(merged(sets, ["g"]), ["g"], "n"), "g", "n") == _rows(df.groupBy("g").agg(F.countDistinct("id").alias("n")), "g", "n")
    assert _rows(count_distinct(df, ["h"], "id", "n"), "h", "n") == _rows(df.groupBy("h").agg(F.countDistinct("id").alias("n")), "h", "n")
    # what is shuffled: a row a word instead of a row a pair
    assert 10 * sets.count() < df.select("g", "h", "id").distinct().count()
