"""Summaries, joins and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.semantics import as_long, int_avg, money_avg, money_sum, month_abbr
from storelens.operators.joins import full_outer_with_small, skew_join
from storelens.sources.tables import Tables


def population_by_state(t: Tables) -> DataFrame:
    return (t.zip_census.groupBy(F.col("Stab").alias("stab"))
            .agg(as_long(F.sum("Males")).alias("males"), as_long(F.sum("Females")).alias("females"))
            .orderBy("stab"))


def foreign_born_by_county(t: Tables) -> DataFrame:
    return (t.zip_census.groupBy(F.col("Stab").alias("stab"), F.col("County").alias("county"))
            .agg(as_long(F.sum("FBEurope")).alias("european_born"))
            .orderBy(F.desc("european_born"), "stab", "county"))


def avg_price_by_group(t: Tables, min_avg: float = 25.0) -> DataFrame:
    exact = F.sum("FullPrice").cast("double") / F.count("FullPrice")
    return (t.products.groupBy(F.col("GroupName").alias("group_name"))
            .agg(exact.alias("_avg"))
            .where(F.col("_avg") > min_avg)
            .select("group_name", F.round("_avg", 6).alias("average_price")))


def price_rollup(t: Tables, exclude: str = "#N/A") -> DataFrame:
    p = t.products.where(F.col("GroupName") != exclude)
    return (p.rollup("GroupName")
            .agg(F.grouping("GroupName").alias("_g"),
                 F.min("FullPrice").alias("min_price"), F.max("FullPrice").alias("max_price"),
                 money_avg("FullPrice").alias("avg_price"))
            .select(F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("GroupName")).alias("group_name"),
                    "min_price", "max_price", "avg_price"))


def product_vs_overall_avg(t: Tables) -> DataFrame:
    # scalar subquery: evaluated once, its one value is attached to every row
    overall = t.products.agg(money_avg("FullPrice")).scalar()
    return (t.products.select(F.col("ProductId").alias("product_id"), F.col("FullPrice").alias("full_price"),
                              overall.alias("average_full_price"))
            .orderBy("product_id"))


def _orders_with_customers(t: Tables, how: str) -> DataFrame:
    """Orders and their customers.  A few customers (the placeholder 0) have a large share of the orders: such
    keys are found in the orders and their rows spread (``skew_join``)."""
    c = t.dimension("customers", "CustomerId", F.col("CustomerId").alias("customer_id"), "HouseholdId", "FirstName")
    return skew_join(t.orders.select("OrderId", "CustomerId", "OrderDate"), c, ["CustomerId"], how).select(
        "customer_id", F.col("HouseholdId").alias("household_id"), F.col("FirstName").alias("first_name"),
        F.col("OrderId").alias("order_id"), F.col("OrderDate").alias("order_date"))


def customer_orders(t: Tables) -> DataFrame:
    return _orders_with_customers(t, "inner").orderBy("customer_id", "order_id")


def all_orders_with_customer(t: Tables) -> DataFrame:
    return _orders_with_customers(t, "left").orderBy(F.asc_nulls_first("customer_id"), "order_id")


def orders_with_state(t: Tables) -> DataFrame:
    o, z = t.orders, t.dimension("zip_census", "zcta5", "Stab")
    return (o.join(z, o.ZipCode == z.zcta5, "left")
            .select(o.OrderId.alias("order_id"), o.ZipCode.alias("zip_code"), z.Stab.alias("stab"))
            .orderBy("order_id"))


def state_orders_x_channel_campaigns(t: Tables, state: str = "WY", channel: str = "WEB") -> DataFrame:
    o = t.orders.where(F.col("State") == state).select(
        F.col("OrderId").alias("order_id"), F.col("CustomerId").alias("customer_id"), F.col("City").alias("city"),
        F.col("CampaignId").alias("_ocamp"))
    c = t.campaigns.where(F.col("Channel") == channel).select(F.col("CampaignId").alias("_ccamp"),
                                                               F.col("Discount").alias("discount"))
    both = full_outer_with_small(o, c, "_ocamp", "_ccamp")
    return both.select("order_id", "customer_id", "city", "discount")


def in_stock_value_by_group(t: Tables, exclude: str = "#N/A") -> DataFrame:
    p = t.products.where((F.col("GroupName") != exclude) & (F.col("IsInStock") == "Y"))
    return (p.groupBy(F.col("GroupName").alias("group_name"))
            .agg(money_sum("FullPrice").alias("total_full_price"))
            .orderBy("total_full_price", "group_name"))


def avg_orders_per_zip(t: Tables) -> DataFrame:
    per_zip = t.orders.groupBy("ZipCode").agg(F.count(F.lit(1)).alias("num"))
    return per_zip.agg(int_avg("num").alias("average_zip_code_order"))


def avg_state_population(t: Tables) -> DataFrame:
    per_state = t.zip_census.groupBy("Stab").agg(F.sum("TotPop").alias("total"))
    return per_state.agg(int_avg("total").alias("average_state_population"))


def max_order_by_customer(t: Tables, exclude_customer: int = 0) -> DataFrame:
    """Order totals from the lines, then the largest order total per customer.

    The line aggregate is hash-partitioned on OrderId, which is also the join
    key, so only the orders side is shuffled for the join; the HAVING on the
    customer key is applied to orders before the join.
    """
    totals = t.order_lines.groupBy("OrderId").agg(F.sum("TotalPrice").alias("order_total"))
    o = t.orders.where(F.col("CustomerId") != exclude_customer).select("OrderId", "CustomerId")
    return (totals.join(o, "OrderId")
            .groupBy(F.col("CustomerId").alias("customer_id"))
            .agg(F.max("order_total").cast("decimal(38,2)").alias("total_price_customer"))
            .orderBy(F.desc("total_price_customer"), "customer_id"))


def orders_by_month_name(t: Tables) -> DataFrame:
    # the calendar decides which orders count; its attributes are a function of the date
    return (t.on_calendar(t.orders, "OrderDate").groupBy(month_abbr("OrderDate").alias("month"))
            .agg(F.count(F.lit(1)).alias("number_of_orders"))
            .orderBy(F.desc("number_of_orders"), "month"))
