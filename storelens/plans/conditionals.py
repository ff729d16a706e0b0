"""Conditional logic and pivots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.semantics import (as_long, in_years, is_blank_len, is_weekend, money_sum,
                                           price_band, year_diff)
from storelens.sources.tables import Tables

# Fixed values of the reference: payment code labels and the price-band labels.
PAYMENT_LABELS = {"AE": "American Express", "DB": "Debit", "MC": "Mastercard", "VI": "Visa"}
PAYMENT_OTHER = "Other"
FREE_LABEL = "Free Orders"
DEFAULT_BAND_EDGES = (0, 10, 100, 1000, 10000)


def band_labels(edges: Sequence[float]) -> list[str]:
    """'Free Orders' for the first edge, then 'Under $<edge>' per upper edge."""
    def num(e: float) -> str:
        return str(int(e)) if float(e).is_integer() else str(e)
    return [FREE_LABEL] + [f"Under ${num(e)}" for e in edges[1:]]


def _flag(cond, hi=100, lo=0):
    return F.when(cond, F.lit(hi)).otherwise(F.lit(lo))


def gender_flags(t: Tables) -> DataFrame:
    g = F.col("Gender")
    return (t.customers.select(
        F.col("CustomerId").alias("customer_id"),
        as_long(_flag(g == "F")).alias("is_female"),
        as_long(_flag(g == "M")).alias("is_male"),
        as_long(_flag(is_blank_len(g) != 1)).alias("is_unknown"))
        .orderBy("customer_id"))


def gender_percentages(t: Tables) -> DataFrame:
    """Three shares in one scan (the reference scans the table once per share)."""
    g = F.col("Gender")

    def share(cond):
        return F.round(F.avg(_flag(cond, 100.0, 0.0)), 2)

    return t.customers.agg(share(g == "M").alias("avg_male"), share(g == "F").alias("avg_female"),
                           share(is_blank_len(g) != 1).alias("avg_unknown"))


def payment_label(c: str = "PaymentType"):
    e = None
    for code, label in PAYMENT_LABELS.items():
        e = F.when(F.col(c) == code, label) if e is None else e.when(F.col(c) == code, label)
    return e.otherwise(PAYMENT_OTHER)


def sales_by_payment_label(t: Tables) -> DataFrame:
    return (t.orders.groupBy(payment_label().alias("payment_type"))
            .agg(money_sum("TotalPrice").alias("sum_total_price"))
            .orderBy("payment_type"))


def orders_by_state_min(t: Tables, min_orders: int = 5000, default: str = "Undefined ZipCode") -> DataFrame:
    # orders are counted per ZIP before the join: the join sees one row per ZIP
    # (no hot ZIP key), and the state totals are sums of exact counts
    per_zip = t.orders.groupBy("ZipCode").agg(F.count(F.lit(1)).alias("_n"))
    z = t.dimension("zip_census", "zcta5", "Stab")
    return (per_zip.join(z, per_zip.ZipCode == z.zcta5, "left")
            .groupBy(F.coalesce(z.Stab, F.lit(default)).alias("stab"))
            .agg(F.sum("_n").alias("number_of_orders"))
            .where(F.col("number_of_orders") >= min_orders)
            .orderBy("stab"))


def first_shipment_volume(t: Tables, years: Sequence[int] = (2009, 2010, 2011)) -> DataFrame:
    ol = t.order_lines.where(in_years("ShipDate", years))
    y = F.year("ShipDate")
    per_year = [F.sum(F.when(y == yr, F.lit(1))) for yr in years]
    return (ol.groupBy(F.col("ProductId").alias("product_id"))
            .agg(as_long(F.coalesce(*per_year)).alias("first_shipment_volume"))
            .orderBy("product_id"))


def order_count_by_channel_pivot(t: Tables,
                                 channels: Sequence[str] = ("WEB", "AD", "MAIL", "REFERRAL")) -> DataFrame:
    o, c = t.orders.select("OrderId", "CampaignId"), t.dimension("campaigns", "CampaignId", "Channel")
    pv = o.join(c, "CampaignId").groupBy().pivot("Channel", list(channels)).agg(F.count("OrderId"))
    # PIVOT's COUNT of an empty cell is 0
    return pv.select(F.lit("Count").alias("campaign_channel"),
                     *[F.coalesce(F.col(ch), F.lit(0)).cast("bigint").alias(ch.lower()) for ch in channels])


def weekend_order_flag(t: Tables) -> DataFrame:
    return t.on_calendar(t.orders, "OrderDate").select(F.col("OrderId").alias("order_id"),
                           _flag(is_weekend("OrderDate"), 100.0, 0.0).alias("weekend_order"))


def weekend_share_by_state(t: Tables) -> DataFrame:
    # per-state sums first (partial aggregation), then the semi join on a handful of rows
    flag = _flag(is_weekend("OrderDate"), 100.0, 0.0)
    per_state = t.on_calendar(t.orders, "OrderDate").groupBy("State").agg(F.sum(flag).alias("_s"), F.count(F.lit(1)).alias("_n"))
    known = t.zip_census.select(F.col("Stab").alias("State")).distinct()
    return (per_state.join(known, "State", "left_semi")
            .select(F.col("State").alias("state"), F.round(F.col("_s") / F.col("_n"), 2).alias("avg_weekend_order"))
            .orderBy(F.desc("avg_weekend_order"), "state"))


def orders_by_price_band(t: Tables, edges: Sequence[float] = DEFAULT_BAND_EDGES) -> DataFrame:
    band = price_band("TotalPrice", edges, band_labels(edges))
    return (t.orders.groupBy(band.alias("price_category"))
            .agg(F.count("OrderId").alias("number_of_orders"))
            .orderBy(F.asc_nulls_first("price_category")))


def subscriber_loyalty_years(t: Tables, max_id: int = 10000,
                             as_of: dt.date = dt.date(2001, 12, 31)) -> DataFrame:
    s = t.subscribers.where(F.col("SubscriberId") < max_id)
    stop = F.coalesce(F.col("StopDate"), F.lit(as_of))
    return (s.groupBy(as_long(year_diff("StartDate", stop)).alias("loyalty_year"))
            .agg(F.count("SubscriberId").alias("number_of_subscribers"))
            .orderBy("loyalty_year"))


def first_year_performance(t: Tables, years: Sequence[int] = (2013, 2014, 2015, 2016)) -> DataFrame:
    o = t.orders.select("CampaignId", "OrderDate", "TotalPrice")
    c = t.dimension("campaigns", "CampaignId", "Channel")
    y = F.year("OrderDate")
    per_year = [F.sum(F.when(y == yr, F.col("TotalPrice"))).cast("double")
                / F.nullif(F.count(F.when(y == yr, F.col("TotalPrice"))), F.lit(0)) for yr in years]
    return (c.join(o, "CampaignId")
            .groupBy(F.col("Channel").alias("channel"))
            .agg(F.round(F.coalesce(*per_year), 6).alias("first_performance")))


def avg_price_state_payment_pivot(t: Tables, types: Sequence[str] = ("AE", "VI", "DB", "MC", "OC")) -> DataFrame:
    pay = F.when(F.col("PaymentType") == "??", F.lit("OC")).otherwise(F.col("PaymentType"))
    # exact partial sums per (ZIP, payment type) before the join with the census
    per_zip = (t.orders.groupBy("ZipCode", pay.alias("PaymentType"))
               .agg(F.sum("TotalPrice").alias("_s"), F.count("TotalPrice").alias("_n")))
    z = t.dimension("zip_census", "zcta5", "Stab")
    pv = (per_zip.join(z, per_zip.ZipCode == z.zcta5)
          .groupBy("Stab").pivot("PaymentType", list(types))
          .agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")))
    return (pv.select(F.col("Stab").alias("stab"),
                      *[F.round(F.col(f"{p}_s").cast("double") / F.nullif(F.col(f"{p}_n"), F.lit(0)), 6)
                        .alias(p.lower()) for p in types])
            .orderBy("stab"))
