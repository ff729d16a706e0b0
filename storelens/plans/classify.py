"""Naive Bayes, lookup models and state signatures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.semantics import MONEY_SUM, as_long, dow_int, in_years, is_weekend, safe_ratio
from storelens.operators.ranking import mode_by_key
from storelens.sources.tables import Tables

# Fixed values of the reference: merged payment label and week labels.
OTHER_PAYMENT = "Other"
WEEKEND, WEEKDAY = "Weekend", "Weekday"


def _high(limit: float) -> Column:
    return F.col("TotalPrice") > F.lit(limit)


def _campaign_orders(t: Tables, year: int) -> DataFrame:
    o = t.orders.where(in_years("OrderDate", [year])).select("OrderId", "CampaignId", "TotalPrice", "PaymentType")
    return o.join(t.dimension("campaigns", "CampaignId", "Channel"), "CampaignId")


def high_order_probability(t: Tables, year: int = 2014, limit: float = 100.0) -> DataFrame:
    d = _campaign_orders(t, year)
    return (d.groupBy(F.col("Channel").alias("channel"))
            .agg(F.round(F.avg(F.when(_high(limit), 1.0).otherwise(0.0)), 6).alias("high_probability"),
                 F.count(F.when(_high(limit), 1)).alias("n_high"),
                 F.count(F.when(_high(limit), None).otherwise(1)).alias("n_not_high"))
            .orderBy("channel"))


def naive_bayes(t: Tables, year: int = 2014, limit: float = 100.0) -> DataFrame:
    """p(channel) * p(payment) / p(all) next to the actual share of high orders.

    The reference crosses the channel and payment tables and keeps the pairs
    that occur; joining both onto the occurring pairs gives the same rows
    without building the cross product."""
    pay = F.when(F.col("PaymentType").isin("??", "OC"), F.lit(OTHER_PAYMENT)).otherwise(F.col("PaymentType"))
    d = _campaign_orders(t, year).select("Channel", pay.alias("PaymentType"),
                                         F.when(_high(limit), 1.0).otherwise(0.0).alias("_h"))
    actual = d.groupBy("Channel", "PaymentType").agg(F.sum("_h").alias("_s"), F.count(F.lit(1)).alias("_n"))
    by_ch = actual.groupBy("Channel").agg(safe_ratio(F.sum("_s"), F.sum("_n")).alias("p_channel"))
    by_pay = actual.groupBy("PaymentType").agg(safe_ratio(F.sum("_s"), F.sum("_n")).alias("p_payment"))
    overall = actual.agg(safe_ratio(F.sum("_s"), F.sum("_n"))).scalar()
    j = actual.join(by_ch, "Channel").join(by_pay, "PaymentType").withColumn("p_overall", overall)
    pred = F.lit(1.0) / F.nullif(F.col("p_overall"), F.lit(0.0)) * F.col("p_channel") * F.col("p_payment")
    return (j.select(F.col("Channel").alias("channel"), F.round("p_channel", 6).alias("p_channel"),
                     F.col("PaymentType").alias("payment_type"), F.round("p_payment", 6).alias("p_payment"),
                     F.round("p_overall", 6).alias("p_overall"), F.round(pred, 6).alias("p_predicted"),
                     F.round(safe_ratio("_s", "_n"), 6).alias("p_actual"))
            .orderBy("channel", "payment_type"))


def lookup_model(rows: DataFrame, key: str, label: str, date: str, split: dt.date,
                 values: Sequence, names: Sequence[str], predicted: str) -> DataFrame:
    """Most frequent label per key before ``split`` (prediction) and from it
    (actual); pivot of the number of keys per (predicted, actual)."""
    # both periods in one aggregate: counts per label and period, then each period's mode per key
    after = F.col(date) >= F.lit(split)
    per_label = rows.groupBy(key, label).agg(F.count(F.when(~after, 1)).alias("_b"), F.count(F.when(after, 1)).alias("_a"))

    def mode(n: str) -> Column:
        return F.min(F.when(F.col(n) > 0, F.struct(F.negative(n).alias("n"), F.col(label).alias("l"))))["l"]

    both = per_label.groupBy(key).agg(mode("_b").alias("_pred"), mode("_a").alias("_act"))
    counts = both.where(F.col("_pred").isNotNull() & F.col("_act").isNotNull()).groupBy("_pred", "_act").agg(F.count(F.lit(1)).alias("_n"))
    pv = counts.groupBy("_pred").pivot("_act", list(values)).agg(F.max("_n"))
    return (pv.select(F.col("_pred").alias(predicted),
                      *[F.col(str(v)).cast("bigint").alias(n) for v, n in zip(values, names)])
            .orderBy(predicted))


def _product_order_dates(t: Tables) -> DataFrame:
    o = t.on_calendar(t.orders, "OrderDate").select("OrderId", "OrderDate")
    return t.order_lines.select("OrderId", "ProductId").join(o, "OrderId")


def lookup_product_dow(t: Tables, split: dt.date = dt.date(2015, 1, 1)) -> DataFrame:
    rows = _product_order_dates(t).withColumn("DOWint", as_long(dow_int("OrderDate")))
    return lookup_model(rows, "ProductId", "DOWint", "OrderDate", split, list(range(1, 8)),
                        [f"d{i}" for i in range(1, 8)], "predicted_dow")


def lookup_product_week(t: Tables, split: dt.date = dt.date(2015, 1, 1)) -> DataFrame:
    rows = _product_order_dates(t).withColumn(
        "Week", F.when(is_weekend("OrderDate"), F.lit(WEEKEND)).otherwise(F.lit(WEEKDAY)))
    return lookup_model(rows, "ProductId", "Week", "OrderDate", split, [WEEKDAY, WEEKEND],
                        ["weekday", "weekend"], "predicted_week")


def lookup_zip_payment(t: Tables, split: dt.date = dt.date(2015, 1, 1),
                       exclude: Sequence[str] = ("OC", "??")) -> DataFrame:
    rows = t.orders.where(~F.col("PaymentType").isin(*exclude)).select("ZipCode", "PaymentType", "OrderDate")
    cards = ["AE", "DB", "MC", "VI"]
    return lookup_model(rows, "ZipCode", "PaymentType", "OrderDate", split, cards, [c.lower() for c in cards],
                        "predicted_payment")


# --- state signature at a cut-off date --------------------------------------

def state_top_payment(t: Tables, cutoff: dt.date = dt.date(2016, 1, 1)) -> DataFrame:
    o = t.orders.where(F.col("OrderDate") < F.lit(cutoff)).select("State", "PaymentType")
    return mode_by_key(o, ["State"], "PaymentType").select(F.col("State").alias("state"),
                                                           F.col("PaymentType").alias("payment_type"))


def state_top_group(t: Tables, cutoff: dt.date = dt.date(2016, 1, 1)) -> DataFrame:
    o = t.orders.where(F.col("OrderDate") < F.lit(cutoff)).select("OrderId", "State")
    # lines are counted per (state, product) before they meet the products
    sold = (o.join(t.order_lines.select("OrderId", "ProductId"), "OrderId")
            .groupBy("State", "ProductId").agg(F.count(F.lit(1)).alias("_lines")))
    rows = sold.join(t.dimension("products", "ProductId", "GroupName"), "ProductId")
    return mode_by_key(rows, ["State"], "GroupName", weight=F.col("_lines")).select(F.col("State").alias("state"),
                                                            F.col("GroupName").alias("group_name"))


def state_orders(t: Tables, cutoff: dt.date = dt.date(2016, 1, 1)) -> DataFrame:
    # orders are summed per (state, customer) before the join with customers:
    # the join input shrinks and the anonymous customer 0 is one row per state
    o = t.orders.where(F.col("OrderDate") < F.lit(cutoff))
    per_cust = o.groupBy("State", "CustomerId").agg(
        F.count("OrderId").alias("_n"), F.sum("TotalPrice").alias("_s"), F.count("TotalPrice").alias("_np"))
    c = t.dimension("customers", "CustomerId", "HouseholdId")
    j = per_cust.join(c, "CustomerId")
    return (j.groupBy(F.col("State").alias("state"))
            .agg(F.sum("_n").alias("n_orders"), F.sum("_s").cast(MONEY_SUM).alias("total_price"),
                 F.round(F.sum("_s").cast("double") / F.sum("_np"), 6).alias("avg_price"),
                 F.sum(F.when(F.col("HouseholdId").isNotNull(), F.col("_n")).otherwise(0)).alias("n_household_ids")))


def state_signature(t: Tables, cutoff: dt.date = dt.date(2016, 1, 1)) -> DataFrame:
    """All of a state's figures from one pass: orders meet their lines once, and one aggregate with grouping sets
    makes the cells per payment type, per customer and per product.  An order's own figures count at its first line.
    Customers and products then give the cells their labels in one join, whose left side is a row per cell."""
    # which line is the first is decided per order; orders and lines stay partitioned by the order after it
    nth = F.row_number().over(Window.partitionBy("OrderId").orderBy("OrderLineId"))
    lines = t.order_lines.select("OrderId", "ProductId", nth.alias("_nth"))
    o = t.orders.where(F.col("OrderDate") < F.lit(cutoff)).select("OrderId", "State", "PaymentType", "CustomerId", "TotalPrice")
    rows = o.join(lines, "OrderId", "left").withColumn("_own", F.coalesce(F.col("_nth") == 1, F.lit(True)))
    price = F.when(F.col("_own"), F.col("TotalPrice"))
    cells = rows.groupingSets([["State", "PaymentType"], ["State", "CustomerId"], ["State", "ProductId"]],
                              "State", "PaymentType", "CustomerId", "ProductId").agg(
        F.grouping_id().alias("_set"), F.count(F.when(F.col("_own"), 1)).alias("_orders"), F.count(F.when(F.col("_own"), F.col("OrderId"))).alias("_ids"),
        F.sum(price).alias("_sum"), F.count(price).alias("_priced"), F.count("_nth").alias("_lines"))
    by_payment, by_customer, by_product = (F.col("_set") == n for n in (0b0011, 0b0101, 0b0110))
    # an order without lines has a cell without product
    cells = cells.where(~by_product | (F.col("_lines") > 0)).withColumn("_id", F.when(by_customer, F.col("CustomerId")).when(by_product, F.col("ProductId")))
    known = t.customers.select(F.lit(0b0101).alias("_kind"), F.col("CustomerId").alias("_key"), F.lit(None).cast("string").alias("_label"), "HouseholdId")
    known = known.unionByName(t.products.select(F.lit(0b0110).alias("_kind"), F.col("ProductId").alias("_key"), F.col("GroupName").alias("_label"),
                                                F.lit(None).cast("bigint").alias("HouseholdId")))
    cells = cells.join(known, (F.col("_set") == F.col("_kind")) & (F.col("_id") == F.col("_key")), "left").where(by_payment | F.col("_kind").isNotNull())
    label = F.when(by_payment, F.col("PaymentType")).when(by_product, F.col("_label"))
    labelled = cells.groupBy("State", "_set", label.alias("_of")).agg(
        F.sum(F.when(by_product, F.col("_lines")).otherwise(F.col("_orders"))).alias("_n"), F.sum("_ids").alias("_ids"), F.sum("_sum").alias("_sum"),
        F.sum("_priced").alias("_priced"), F.sum(F.when(F.col("HouseholdId").isNotNull(), F.col("_ids")).otherwise(0)).alias("_households"))

    def most(cell: Column) -> Column:
        return F.min(F.when(cell, F.struct(F.negative("_n").alias("n"), F.col("_of").alias("of"))))

    def total(c: str) -> Column:
        return F.sum(F.when(by_customer, F.col(c)))

    states = labelled.where(F.col("State") != "").groupBy(F.col("State").alias("state")).agg(
        total("_ids").alias("n_orders"), total("_sum").cast(MONEY_SUM).alias("total_price"),
        F.round(total("_sum").cast("double") / F.nullif(total("_priced"), F.lit(0)), 6).alias("avg_price"),
        total("_households").alias("n_household_ids"), most(by_payment).alias("_pay"), most(by_product).alias("_group"))
    found = F.col("n_orders").isNotNull() & F.col("_pay").isNotNull() & F.col("_group").isNotNull()
    return states.where(found).select("state", "n_orders", "total_price", "avg_price", "n_household_ids", F.col("_pay.of").alias("top_payment"),
                                      F.col("_group.of").alias("top_group"), F.lit(cutoff).alias("cutoff_date")).orderBy("state")


def three_years_of_sales(t: Tables, cutoff: dt.date = dt.date(2014, 1, 1)) -> DataFrame:
    """Sales per state for the cut-off's year and the two before, as fixed
    column names; the years are known when the plan is built, so the pivot
    needs no extra pass to find its values."""
    y = cutoff.year
    o = t.orders.select("State", "TotalPrice", F.year("OrderDate").alias("_year"))
    pv = o.groupBy("State").pivot("_year", [y - 2, y - 1, y]).agg(F.sum("TotalPrice"))
    names = ("y_minus_2", "y_minus_1", "y")
    return pv.select(F.col("State").alias("state"),
                     *[F.col(str(v)).cast("decimal(38,2)").alias(n) for v, n in zip((y - 2, y - 1, y), names)]
                     ).orderBy("state")
