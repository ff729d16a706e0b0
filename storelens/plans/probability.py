"""Probabilities and odds.

Shares are computed from one grouped aggregate: the denominator is the sum of
the group counts over an unpartitioned window of that (bounded, already
aggregated) result, so the base table is scanned once instead of once per CTE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.semantics import as_long, dow_int, dow_name, price_band, safe_ratio
from storelens.plans.conditionals import DEFAULT_BAND_EDGES, band_labels
from storelens.operators.joins import skew_join
from storelens.sources.tables import Tables


def odds_payment(t: Tables, types: Sequence[str] = ("OC",), base: Sequence[str] | None = None) -> DataFrame:
    o = t.orders
    in_base = F.lit(True) if base is None else F.col("PaymentType").isin(*base)
    agg = o.agg(F.count(F.when(F.col("PaymentType").isin(*types), F.col("OrderId"))).alias("hit"),
                F.count(F.when(in_base, F.col("OrderId"))).alias("total"))
    p = safe_ratio("hit", "total")
    return agg.select(F.round(p, 2).alias("probability"), F.round(p / F.nullif(1 - p, F.lit(0.0)), 2).alias("odds"))


def _share(grouped: DataFrame, count_col: str, total_col: str, digits: int) -> DataFrame:
    return (grouped.withColumn(total_col, F.sum(count_col).over(Window.partitionBy()))
            .withColumn("probability", F.round(safe_ratio(count_col, total_col), digits)))


def share_by_payment(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.col("PaymentType").alias("payment_type")).agg(F.count("OrderId").alias("nb"))
    return _share(g, "nb", "total", 4)


def share_by_gender(t: Tables) -> DataFrame:
    c = t.customers.where(F.col("Gender").isin("M", "F"))
    g = c.groupBy(F.col("Gender").alias("gender")).agg(F.count(F.lit(1)).alias("total_gender"))
    return _share(g, "total_gender", "total", 2)


def share_by_weekday(t: Tables) -> DataFrame:
    g = (t.on_calendar(t.orders, "OrderDate").groupBy(dow_name("OrderDate").alias("dow"), as_long(dow_int("OrderDate")).alias("dow_int"))
         .agg(F.count(F.lit(1)).alias("orders_per_day")))
    return _share(g, "orders_per_day", "total", 2).orderBy("dow_int")


def share_by_channel(t: Tables) -> DataFrame:
    o, c = t.orders.select("OrderId", "CampaignId"), t.dimension("campaigns", "CampaignId", "Channel")
    g = (o.join(c, "CampaignId").groupBy(F.col("Channel").alias("channel"))
         .agg(F.count(F.lit(1)).alias("orders_per_channel")))
    return _share(g, "orders_per_channel", "total", 3)


def product_gender_share(t: Tables, group: str = "BOOK") -> DataFrame:
    p = t.products.where(F.col("GroupName") == group).select("ProductId", "GroupName")
    ol = t.order_lines.select("OrderId", "ProductId")
    o = t.orders.select("OrderId", "CustomerId")
    c = t.customers.where(F.col("Gender").isin("M", "F")).select("CustomerId", "Gender")
    # orders meet the known-gender customers first, so orders of customer 0 and of
    # unknown gender are gone before the shuffle on OrderId
    known = skew_join(o, c, ["CustomerId"])
    rows = p.join(ol, "ProductId").join(known, "OrderId")
    g = F.col("Gender")
    agg = (rows.groupBy(F.col("ProductId").alias("product_id"), F.col("GroupName").alias("group_name"))
           .agg(F.count(F.when(g == "F", 1)).alias("total_female"), F.count(F.when(g == "M", 1)).alias("total_male"),
                F.count(F.lit(1)).alias("total_mf")))
    return (agg.withColumn("proba_female", F.round(safe_ratio("total_female", "total_mf"), 2))
            .withColumn("proba_male", F.round(safe_ratio("total_male", "total_mf"), 2))
            .orderBy(F.desc("proba_male"), "product_id"))


def state_population_share(t: Tables) -> DataFrame:
    g = t.zip_census.groupBy(F.col("Stab").alias("stab")).agg(as_long(F.sum("TotPop")).alias("state_pop"))
    return _share(g, "state_pop", "country_pop", 3)


# Fixed values of the reference: commute columns and their output names.
COMMUTE = (("DriveAlone", "drive_alone"), ("Carpool", "carpool"), ("PublicTrans", "public_trans"),
           ("WalkToWork", "walk"), ("OtherCommute", "other"), ("WorkAtHome", "work_at_home"))


def commute_shares(t: Tables, states: Sequence[str] = ("WA", "OR", "CA", "AK")) -> DataFrame:
    z = t.zip_census.where(F.col("Stab").isin(*states))
    sums = z.groupBy(F.col("Stab").alias("state")).agg(
        F.sum("Worker16").alias("_w"), *[F.sum(c).alias(f"_{n}") for c, n in COMMUTE])
    return sums.select("state", *[F.round(safe_ratio(f"_{n}", "_w"), 2).alias(n) for _, n in COMMUTE])


def share_by_price_band(t: Tables, edges: Sequence[float] = DEFAULT_BAND_EDGES) -> DataFrame:
    band = price_band("TotalPrice", edges, band_labels(edges))
    g = t.orders.groupBy(band.alias("price_category")).agg(F.count("OrderId").alias("number_of_orders"))
    return _share(g, "number_of_orders", "total", 3).orderBy(F.asc_nulls_first("price_category"))


def foreign_born_share(t: Tables, zips: Sequence[str] = ("06902", "06118", "06762")) -> DataFrame:
    z = t.zip_census.where(F.col("zcta5").isin(*zips))
    return (z.select(F.col("Stab").alias("stab"), F.col("ZIPName").alias("zip_name"), F.col("County").alias("county"),
                     F.col("FBMinusSea").alias("fb_minus_sea"), F.col("TotPop").alias("tot_pop"),
                     F.round(safe_ratio("FBMinusSea", "TotPop"), 2).alias("probability"))
            .orderBy(F.asc_nulls_first("probability"), "zip_name"))


def age_shares(t: Tables, state: str = "DE") -> DataFrame:
    z = t.zip_census.where((F.col("TotPop") != 0) & (F.col("Stab") == state))
    g = z.groupBy(F.col("Stab").alias("stab")).agg(
        as_long(F.sum("TotPop")).alias("tot_pop"),
        as_long(F.sum(F.col("Under18") + (F.col("Over18") - F.col("Over21")))).alias("n_0_20"),
        as_long(F.sum(F.col("Over21") - F.col("Over65"))).alias("n_21_64"),
        as_long(F.sum("Over65")).alias("n_65"))
    return g.select("*", *[F.round(safe_ratio(f"n_{s}", "tot_pop"), 2).alias(f"p_{s}") for s in ("0_20", "21_64", "65")])
