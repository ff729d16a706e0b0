"""Window functions.

Windows over aggregated, bounded domains (states, counties, months, rate
plans) use Spark's window operator directly.  Row-level numbering over data
that grows with the input (products, customers) goes through
``operators.ranking`` instead of a single-task window, and the monthly median
through ``operators.percentiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.semantics import MONEY_SUM, as_long, in_years, money_avg, money_sum, month_abbr
from storelens.operators.percentiles import exact_percentiles
from storelens.operators.ranking import asc, desc, ntile, top_k_per_group
from storelens.sources.tables import Tables


def state_population_rank(t: Tables) -> DataFrame:
    per_state = t.zip_census.groupBy(F.col("Stab").alias("state")).agg(as_long(F.sum("TotPop")).alias("total_pop"))
    # one row per state: a bounded domain, so a global window is cheap here
    w = Window.orderBy("total_pop", "state")
    return per_state.withColumn("population_rank", as_long(F.row_number().over(w))).orderBy("state")


def county_rank_variants(t: Tables, state: str = "AL") -> DataFrame:
    per_county = (t.zip_census.where(F.col("Stab") == state)
                  .groupBy("Stab", F.col("County").alias("county"))
                  .agg(as_long(F.sum("FBEurope")).alias("european_born"))
                  .where(F.col("european_born") > 0))
    w = Window.orderBy("european_born")
    return (per_county.select(
        "county", "european_born",
        as_long(F.row_number().over(Window.orderBy("european_born", "county"))).alias("sequence"),
        as_long(F.rank().over(w)).alias("rank"),
        as_long(F.dense_rank().over(w)).alias("no_gap_rank"))
        .orderBy("european_born", "sequence"))


def price_quartiles(t: Tables, group: str = "GAME", tiles: int = 4) -> DataFrame:
    p = (t.products.where((F.col("GroupName") == group) & (F.col("IsInStock") == "Y"))
         .select(F.col("ProductId").alias("product_id"), F.col("FullPrice").alias("full_price")))
    q = ntile(p, tiles, [desc("full_price"), asc("product_id")], name="quartile")
    return q.select("product_id", "full_price", as_long("quartile").alias("quartile"))


def top_decile_customers(t: Tables, state: str = "AL", years: Sequence[int] = (2015, 2016),
                         tiles: int = 10) -> DataFrame:
    o = t.orders.where((F.col("State") == state) & (F.col("CustomerId") != 0) & in_years("OrderDate", years))
    per_year = (o.groupBy(as_long(F.year("OrderDate")).alias("year_order"), F.col("CustomerId").alias("customer"))
                .agg(money_sum("TotalPrice").alias("total_price")))
    tiled = ntile(per_year, tiles, [desc("total_price"), asc("customer")], partition_by=["year_order"],
                  name="group10")
    return (tiled.where(F.col("group10") == 1)
            .select("year_order", "customer", "total_price").orderBy("year_order", "customer"))


def order_summary_by_year(t: Tables) -> DataFrame:
    """The reference's window + DISTINCT is a plain GROUP BY (one shuffle, partial aggregation)."""
    o = t.orders.where(F.col("TotalPrice") != 0)
    return (o.groupBy(as_long(F.year("OrderDate")).alias("year_order"))
            .agg(F.min("TotalPrice").alias("min_price"), F.max("TotalPrice").alias("max_price"),
                 money_avg("TotalPrice", 2).alias("avg_price"), money_sum("TotalPrice").alias("sum_price"),
                 F.count("OrderId").alias("count_order"), F.count("OrderId").alias("count_big_order"))
            .orderBy("year_order"))


def fee_dispersion_by_plan(t: Tables, max_id: int = 10000) -> DataFrame:
    s = t.subscribers.where(F.col("SubscriberId") < max_id)
    fee = F.col("MonthlyFee")
    return s.groupBy(F.col("RatePlan").alias("rate_plan")).agg(
        money_avg(fee, 2).alias("avg_fee"),
        F.round(F.var_samp(fee), 2).alias("var_fee"),
        F.round(F.var_pop(fee), 2).alias("varp_fee"),
        F.round(F.stddev_samp(fee), 2).alias("stdev_fee"),
        F.round(F.stddev_pop(fee), 2).alias("stdevp_fee"))


def month_vs_first_year(t: Tables, years: Sequence[int] = (2013, 2014, 2015)) -> DataFrame:
    o = t.on_calendar(t.orders.where(in_years("OrderDate", years)), "OrderDate")
    monthly = (o.groupBy(as_long(F.year("OrderDate")).alias("order_year"), F.month("OrderDate").alias("_month"),
                         month_abbr("OrderDate").alias("month_abbr"))
               .agg(money_sum("TotalPrice").alias("sum_price")))
    w = Window.partitionBy("_month").orderBy("order_year")
    first = F.first("sum_price").over(w)
    return (monthly.withColumn("first_value", first)
            .withColumn("gap", (F.col("sum_price") - F.col("first_value")).cast(MONEY_SUM))
            .orderBy("_month", "order_year")
            .select("order_year", "month_abbr", "sum_price", "first_value", "gap"))


def new_subscribers_vs_last_plan(t: Tables, years: Sequence[int] = (2003, 2004, 2005, 2006)) -> DataFrame:
    s = t.on_calendar(t.subscribers.where(in_years("StartDate", years)), "StartDate")
    counts = (s.groupBy(as_long(F.year("StartDate")).alias("subs_year"), F.col("RatePlan").alias("rate_plan"))
              .agg(F.count("SubscriberId").alias("subs_num")))
    w = (Window.partitionBy("subs_year").orderBy("rate_plan")
         .rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return (counts.withColumn("last_value", F.last("subs_num").over(w))
            .withColumn("gap", F.col("last_value") - F.col("subs_num"))
            .orderBy("subs_year", "rate_plan"))


def best_sellers_prev_next(t: Tables, k: int = 10, exclude: Sequence[str] = ("#N/A", "FREEBIE")) -> DataFrame:
    p = t.products.where(~F.col("GroupName").isin(*exclude)).select("ProductId", "GroupName")
    # lines are summed per product before the join: one row per product meets the products
    sold = t.order_lines.groupBy("ProductId").agg(money_sum("TotalPrice").alias("sum_price"))
    sales = sold.join(p, "ProductId").select(F.col("GroupName").alias("group_name"), F.col("ProductId").alias("product_id"), "sum_price")
    w = Window.partitionBy("group_name").orderBy(F.desc("sum_price"), "product_id")
    # top k per group without sorting a whole group in one task; LAG/LEAD then
    # run over the k kept rows per group only
    top = top_k_per_group(sales, ["group_name"], [desc("sum_price"), asc("product_id")], k)
    return (top.select("group_name", "product_id", "sum_price",
                       F.lag("sum_price").over(w).alias("prev_price"),
                       F.lead("sum_price").over(w).alias("next_price"))
            .orderBy("group_name", F.desc("sum_price"), "product_id"))


def county_population_distribution(t: Tables, states: Sequence[str] = ("NV", "WY")) -> DataFrame:
    z = t.zip_census.where(F.col("Stab").isin(*states) & F.col("County").isNotNull())
    per_county = (z.groupBy(F.col("Stab").alias("stab"), F.col("County").alias("county"))
                  .agg(as_long(F.sum("TotPop")).alias("sum_pop")))
    w = Window.partitionBy("stab").orderBy("sum_pop")
    return per_county.select("stab", "county", "sum_pop",
                             F.round(F.percent_rank().over(w), 2).alias("percent_rank"),
                             F.round(F.cume_dist().over(w), 2).alias("cume_dist"))


def median_order_by_month(t: Tables, p: float = 0.5, approx: bool = False) -> DataFrame:
    """Continuous and discrete median of the order totals per month; exact by
    default, or Spark's mergeable sketch when ``approx`` (PERCENTILE_DISC-like
    value for both columns, relative rank error 1e-4)."""
    o = t.on_calendar(t.orders, "OrderDate").select(as_long(F.year("OrderDate")).alias("year"), as_long(F.month("OrderDate")).alias("month"),
                        month_abbr("OrderDate").alias("month_abbr"), "TotalPrice")
    keys = ["year", "month", "month_abbr"]
    if approx:
        a = F.percentile_approx("TotalPrice", p, 10000)
        med = o.groupBy(*keys).agg(a.cast("double").alias("percentile_cont"), a.alias("percentile_disc"))
    else:
        med = exact_percentiles(o, keys, "TotalPrice", p)
    return (med.select("year", "month", "month_abbr", F.round("percentile_cont", 4).alias("percentile_cont"),
                       "percentile_disc")
            .orderBy("year", "month"))
