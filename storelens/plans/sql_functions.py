"""The parameterised functions as Spark SQL functions.

``register_functions(t)`` registers the nine relations as views (reference
names) and the functions as temporary SQL functions, so that reference-style
calls run unchanged in ``spark.sql``:

    SELECT * FROM orders_with_delay(10) ORDER BY delay DESC;
    SELECT count_orders_with_delay(100) AS number_of_orders;
    SELECT * FROM areas_closest_in_size(34.02, 10) ORDER BY area_sqmi;

Each body is one SELECT that Spark inlines into the calling query, like the
reference's inline table functions.  The bodies in ``SHARED`` are the only definition of their
functions: ``plans.parameterised`` reads them through ``table``.  The others equal the DataFrame functions
(tests/test_sql_functions.py), which differ in form: bitmap counts, spatial bounds, one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from storelens.functions.geo_sql import dbl, ellipsoid
from storelens.sources.tables import REFERENCE_NAMES, Tables, register_views


@dataclass(frozen=True)
class Function:
    """A SQL function: declared parameters and result, and its SELECT, in which {Name} is a
    relation and :name a parameter."""

    parameters: str
    returns: str
    body: str

    def declaration(self, prefix: str) -> str:
        relations = {name: prefix + name for name in REFERENCE_NAMES.values()}
        return f"({self.parameters}) RETURNS {self.returns} RETURN {re.sub(r':([a-z_]+)', r'\1', self.body).format(**relations)}"


_DELAYS = """(SELECT a.OrderId AS order_id, o.OrderDate AS order_date, a.max_date,
         CAST(datediff(a.max_date, o.OrderDate) AS BIGINT) AS delay
  FROM (SELECT OrderId, max(ShipDate) AS max_date FROM {OrderLines} GROUP BY OrderId) a
  JOIN {Orders} o ON o.OrderId = a.OrderId)
  WHERE delay >= :days"""

SHARED = {
    "orders_with_delay": Function(
        "days INT", "TABLE (order_id BIGINT, order_date DATE, max_date DATE, delay BIGINT)",
        f"SELECT order_id, order_date, max_date, delay FROM {_DELAYS}"),
    "count_orders_with_delay": Function(
        "days INT", "BIGINT", f"SELECT count(*) AS number_of_orders FROM {_DELAYS}"),
    # Spark turns the bound on the number into a partial top-n, so the window numbers n rows
    "top_products": Function(
        "n INT", "TABLE (product_id BIGINT, total_units BIGINT)",
        """SELECT product_id, total_units FROM
  (SELECT ProductId AS product_id, CAST(sum(NumUnits) AS BIGINT) AS total_units,
          row_number() OVER (ORDER BY sum(NumUnits) DESC, ProductId) AS top_rank
   FROM {OrderLines} GROUP BY ProductId)
  WHERE top_rank <= :n"""),
    "customers_by_purchase": Function(
        "lo DECIMAL(19,4), hi DECIMAL(19,4)",
        "TABLE (customer_id BIGINT, order_id BIGINT, total_price DECIMAL(12,2), order_date DATE)",
        """SELECT CustomerId AS customer_id, OrderId AS order_id, TotalPrice AS total_price, OrderDate AS order_date
  FROM {Orders}
  WHERE TotalPrice BETWEEN CAST(:lo AS DECIMAL(19,4)) AND CAST(:hi AS DECIMAL(19,4)) AND CustomerId != 0"""),
    "areas_named_like": Function(
        "txt STRING", "TABLE (state STRING, zcta5 STRING, zip_name STRING, county STRING, stab STRING, tot_pop BIGINT)",
        """SELECT state, zcta5, ZIPName AS zip_name, County AS county, Stab AS stab, TotPop AS tot_pop FROM {ZipCensus}
  WHERE upper(County) LIKE upper(concat('%', :txt, '%'))"""),
    "active_subscribers": Function(
        "cutoff DATE",
        "TABLE (SubscriberId BIGINT, RatePlan STRING, MonthlyFee DECIMAL(12,2), StartDate DATE, StopDate DATE)",
        """SELECT SubscriberId, RatePlan, MonthlyFee, StartDate, StopDate FROM {Subscribers}
  WHERE StartDate <= :cutoff AND (StopDate IS NULL OR StopDate >= :cutoff)"""),
    "state_info": Function(
        "stab_p STRING",  # another name than the column's, which would win
        """TABLE (total_pop BIGINT, avg_pop BIGINT, min_pop BIGINT, max_pop BIGINT, n_areas BIGINT,
               var_pop DOUBLE, stddev_pop DOUBLE)""",
        """SELECT CAST(sum(TotPop) AS BIGINT) AS total_pop, CAST(sum(TotPop) div count(TotPop) AS BIGINT) AS avg_pop,
    min(TotPop) AS min_pop, max(TotPop) AS max_pop, count(zcta5) AS n_areas,
    round(var_pop(TotPop), 2) AS var_pop, round(stddev_pop(TotPop), 2) AS stddev_pop
  FROM {ZipCensus} WHERE Stab = :stab_p"""),
}


def table(t: Tables, name: str, **args: Any) -> DataFrame:
    """The rows of a function of ``SHARED`` over ``t``, without registering anything."""
    body = SHARED[name].body
    used = {n: getattr(t, attr) for attr, n in REFERENCE_NAMES.items() if f"{{{n}}}" in body}
    return t.spark.sql(body, args=args, **used)


def _definitions(p: str) -> dict[str, str]:
    dist = ellipsoid("z.Latitude", "z.Longitude", "lat", "lon")
    return {
        "areas_other_language": f"""(lim DOUBLE)
RETURNS TABLE (stab STRING, county STRING, tot_pop BIGINT, over5 BIGINT, non_en_sp DOUBLE)
RETURN SELECT Stab, County, TotPop, Over5, CAST(OthLang - Spanish AS DOUBLE) / Over5
  FROM {p}ZipCensus WHERE Over5 != 0 AND CAST(OthLang - Spanish AS DOUBLE) / nullif(Over5, 0) >= lim""",
        "areas_closest_in_size": f"""(area DOUBLE DEFAULT 0.0, n INT DEFAULT 10)
RETURNS TABLE (stab STRING, county STRING, area_sqmi DOUBLE)
RETURN SELECT Stab, County, AreaSQMI FROM
  (SELECT Stab, County, AreaSQMI, row_number() OVER (ORDER BY abs(AreaSQMI - area), zcta5) AS seq
   FROM {p}ZipCensus)
  WHERE seq <= n""",
        "areas_around_point": f"""(lat DOUBLE, lon DOUBLE, radius INT)
RETURNS TABLE (stab STRING, zcta5 STRING, zip_name STRING, county STRING, longitude DOUBLE, latitude DOUBLE,
               distance DECIMAL(18,0))
RETURN SELECT Stab, zcta5, ZIPName, County, Longitude, Latitude,
    CAST(round(round(distance, 2), 0) AS DECIMAL(18,0))
  FROM (SELECT z.*, {dist} AS distance FROM {p}ZipCensus z
        WHERE z.Latitude BETWEEN lat - radius / {dbl(68.0)} AND lat + radius / {dbl(68.0)})
  WHERE distance < radius""",
        "customers_per_month": f"""(focus_year INT)
RETURNS TABLE (month_order BIGINT, number_of_customers BIGINT)
RETURN SELECT CAST(month(OrderDate) AS BIGINT), count(DISTINCT CustomerId) FROM {p}Orders
  WHERE OrderDate >= make_date(focus_year, 1, 1) AND OrderDate < make_date(focus_year + 1, 1, 1)
  GROUP BY month(OrderDate)""",
        "state_top_payment": f"""(cutoff DATE)
RETURNS TABLE (state STRING, payment_type STRING)
RETURN SELECT State, min(struct(-n AS n, PaymentType AS label)).label
  FROM (SELECT State, PaymentType, count(*) AS n FROM {p}Orders WHERE OrderDate < cutoff GROUP BY State, PaymentType)
  GROUP BY State""",
        "state_top_group": f"""(cutoff DATE)
RETURNS TABLE (state STRING, group_name STRING)
RETURN SELECT State, min(struct(-n AS n, GroupName AS label)).label
  FROM (SELECT s.State, p.GroupName, sum(s.n) AS n
        FROM (SELECT o.State, l.ProductId, count(*) AS n FROM {p}Orders o JOIN {p}OrderLines l ON l.OrderId = o.OrderId
              WHERE o.OrderDate < cutoff GROUP BY o.State, l.ProductId) s
        JOIN {p}Products p ON p.ProductId = s.ProductId GROUP BY s.State, p.GroupName)
  GROUP BY State""",
        "state_orders": f"""(cutoff DATE)
RETURNS TABLE (state STRING, n_orders BIGINT, total_price DECIMAL(38,2), avg_price DOUBLE, n_household_ids BIGINT)
RETURN SELECT s.State, sum(s.n), CAST(sum(s.total) AS DECIMAL(38,2)), round(CAST(sum(s.total) AS DOUBLE) / sum(s.priced), 6),
    sum(if(c.HouseholdId IS NOT NULL, s.n, 0))
  FROM (SELECT State, CustomerId, count(*) AS n, sum(TotalPrice) AS total, count(TotalPrice) AS priced
        FROM {p}Orders WHERE OrderDate < cutoff GROUP BY State, CustomerId) s
  JOIN {p}Customers c ON c.CustomerId = s.CustomerId GROUP BY s.State""",
        "state_signature": f"""(cutoff DATE)
RETURNS TABLE (state STRING, n_orders BIGINT, total_price DECIMAL(38,2), avg_price DOUBLE, n_household_ids BIGINT,
               top_payment STRING, top_group STRING, cutoff_date DATE)
RETURN SELECT a.state, a.n_orders, a.total_price, a.avg_price, a.n_household_ids, b.payment_type, d.group_name, cutoff
  FROM {p}state_orders(cutoff) a JOIN {p}state_top_payment(cutoff) b ON b.state = a.state
  JOIN {p}state_top_group(cutoff) d ON d.state = a.state WHERE a.state <> ''""",
        "three_years_of_sales": f"""(cutoff DATE)
RETURNS TABLE (state STRING, y_minus_2 DECIMAL(38,2), y_minus_1 DECIMAL(38,2), y DECIMAL(38,2))
RETURN SELECT State, CAST(sum(TotalPrice) FILTER (WHERE back = 2) AS DECIMAL(38,2)),
    CAST(sum(TotalPrice) FILTER (WHERE back = 1) AS DECIMAL(38,2)), CAST(sum(TotalPrice) FILTER (WHERE back = 0) AS DECIMAL(38,2))
  FROM (SELECT State, TotalPrice, year(cutoff) - year(OrderDate) AS back FROM {p}Orders)
  GROUP BY State""",
    }


def register_functions(t: Tables, prefix: str = "") -> list[str]:
    """Register views and functions; returns the function names."""
    spark: SparkSession = t.spark
    register_views(t, prefix)
    names = []
    shared = {name: f.declaration(prefix) for name, f in SHARED.items()}
    for name, body in {**shared, **_definitions(prefix)}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
        names.append(prefix + name)
    return names
