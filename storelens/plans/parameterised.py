"""Parameterised table and scalar functions.

Each function composes plan nodes (those that ``plans.sql_functions`` defines once for both uses are read from there), so a caller's filters and projections are
optimised together with the function body (the reference's inline functions
behave the same way).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.distinct import count_distinct
from storelens.functions.semantics import as_long, in_years, safe_ratio
from storelens.operators.ranking import asc, top_n
from storelens.operators.spatial import within_of_point
from storelens.plans.sql_functions import table
from storelens.sources.tables import Tables


def orders_with_delay(t: Tables, days: int = 10) -> DataFrame:
    return table(t, "orders_with_delay", days=days).orderBy(F.desc("delay"), "order_id")


def count_orders_with_delay(t: Tables, days: int = 10) -> DataFrame:
    return table(t, "count_orders_with_delay", days=days)


def top_products(t: Tables, n: int = 10) -> DataFrame:
    return table(t, "top_products", n=n).orderBy(F.desc("total_units"), "product_id")


def areas_other_language(t: Tables, limit: float = 0.66) -> DataFrame:
    z = t.zip_census.where(F.col("Over5") != 0)
    ratio = safe_ratio(F.col("OthLang") - F.col("Spanish"), F.col("Over5"))
    return (z.where(ratio >= limit)
            .select(F.col("Stab").alias("stab"), F.col("County").alias("county"), F.col("TotPop").alias("tot_pop"),
                    F.col("Over5").alias("over5"), F.round(ratio, 6).alias("non_en_sp"), "zcta5")
            .orderBy(F.desc("non_en_sp"), "zcta5").drop("zcta5"))


def areas_closest_in_size(t: Tables, area: float = 0.0, n: int = 10) -> DataFrame:
    z = t.zip_census.select("Stab", "County", "AreaSQMI", "zcta5")
    best = top_n(z, n, [asc(F.abs(F.col("AreaSQMI") - F.lit(float(area)))), asc("zcta5")])
    return (best.orderBy("AreaSQMI", "zcta5")
            .select(F.col("Stab").alias("stab"), F.col("County").alias("county"), F.col("AreaSQMI").alias("area_sqmi")))


def customers_by_purchase(t: Tables, lo: float = 19.63, hi: float = 39.95) -> DataFrame:
    return table(t, "customers_by_purchase", lo=lo, hi=hi).orderBy("customer_id", "order_date", "order_id")


def areas_named_like(t: Tables, text: str = "South") -> DataFrame:
    return table(t, "areas_named_like", txt=text).orderBy("county", "zcta5")


def active_subscribers(t: Tables, cutoff: dt.date = dt.date(2015, 10, 12)) -> DataFrame:
    return table(t, "active_subscribers", cutoff=cutoff).orderBy("StartDate", "SubscriberId")


def areas_around_point(t: Tables, lat: float = 39.8, lon: float = -98.6, radius: float = 10.0) -> DataFrame:
    z = t.zip_census.select("Stab", "zcta5", "ZIPName", "County", "Longitude", "Latitude")
    near = within_of_point(z, lat, lon, radius, metric="ellipsoid")
    # the declared result column is numeric(18,0) filled from text with 2 decimals
    shown = F.round(F.round(F.col("distance"), 2), 0).cast("decimal(18,0)")
    return (near.orderBy("distance", "zcta5")
            .select(F.col("Stab").alias("stab"), "zcta5", F.col("ZIPName").alias("zip_name"),
                    F.col("County").alias("county"), F.col("Longitude").alias("longitude"),
                    F.col("Latitude").alias("latitude"), shown.alias("distance")))


def state_info(t: Tables, state: str = "NY") -> DataFrame:
    return table(t, "state_info", stab_p=state)


def customers_per_month(t: Tables, year: int = 2013) -> DataFrame:
    o = t.orders.where(in_years("OrderDate", [year]))
    o = o.select(as_long(F.month("OrderDate")).alias("month_order"), "CustomerId")
    return count_distinct(o, ["month_order"], "CustomerId", "number_of_customers").orderBy("month_order")
