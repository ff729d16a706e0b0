"""Invariants between queries."""

import pytest
from pyspark.sql import functions as F

from storelens.plans import parameterised as s6
from storelens.plans import probability as s7
from storelens.plans import quality as s3
from storelens.plans import sampling as s8
from storelens.plans import windows as s4


def test_delay_count_equals_list(tables):
    for days in (10, 100):
        n = s6.count_orders_with_delay(tables, days).first().number_of_orders
        assert n == s6.orders_with_delay(tables, days).count()


@pytest.mark.parametrize("fn,count_col,total_col", [
    (s7.share_by_payment, "nb", "total"), (s7.share_by_weekday, "orders_per_day", "total"),
    (s7.share_by_channel, "orders_per_channel", "total"), (s7.share_by_price_band, "number_of_orders", "total")])
def test_shares_sum_to_one(tables, fn, count_col, total_col):
    rows = fn(tables).collect()
    assert sum(r[count_col] for r in rows) == rows[0][total_col]


def test_repairs_partition_inputs_and_are_idempotent(tables):
    r = s3.repair_pipeline(tables)
    assert r["orders_unknown_zip"].count() + r["orders_repaired"].count() == tables.orders.count()
    assert r["order_lines_orphans"].count() + r["order_lines_repaired"].count() == tables.order_lines.count()
    census_ok = r["zip_census_repaired"]
    again = r["orders_repaired"].join(census_ok, F.col("ZipCode") == census_ok.zcta5, "left_semi")
    assert again.count() == r["orders_repaired"].count()


def test_placeholder_customer_resolves_unknown_customers(tables):
    r = s3.repair_pipeline(tables)
    assert r["orders_unknown_customer"].where(F.col("customer_id") != 0).count() == 0
    fixed = s3.not_in(r["orders_repaired"], "CustomerId", s3.customers_with_placeholder(tables), "CustomerId")
    assert fixed.count() == 0


def test_quartile_sizes(tables):
    q = s4.price_quartiles(tables, group="LARGE")
    sizes = [r[1] for r in q.groupBy("quartile").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_balanced_sample_bound(tables):
    s = s8.sample_balanced(tables, k=50, year=2000, min_price=250000.0)
    per_class = s.groupBy(F.col("weekend").isNull()).count().collect()
    assert all(r[1] <= 50 for r in per_class)


def test_reference_sql_runs_on_registered_views(spark, tables):
    from storelens.plans import summaries
    from storelens.sources.tables import register_views
    register_views(tables, prefix="ref_")
    sql = spark.sql("""
        WITH CTE_TotalPriceOrder AS (
          SELECT OrderId, SUM(TotalPrice) AS TotalPriceOrder FROM ref_OrderLines GROUP BY OrderId)
        SELECT o.CustomerID AS customer_id, MAX(cte.TotalPriceOrder) AS total_price_customer
        FROM CTE_TotalPriceOrder cte JOIN ref_Orders o ON o.OrderId = cte.OrderId
        GROUP BY o.CustomerID HAVING o.CustomerID <> 0""")
    lib = summaries.max_order_by_customer(tables)
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, lib.collect()))
