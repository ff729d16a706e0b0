"""DuckDB oracle texts for the summaries."""

_MEAN = "sum(FullPrice)::DOUBLE / count(FullPrice)"
_ORDER = "OrderId AS order_id, OrderDate AS order_date"
_CUSTOMER = "c.CustomerId AS customer_id, c.HouseholdId AS household_id, c.FirstName AS first_name"


def _mean_of_counts(counted: str, table: str, key: str, out: str) -> str:
    """The mean per key, cut to an integer: the whole by the number of keys (rows of a NULL key are one key)."""
    return f"""
SELECT ({counted} // nullif(count(DISTINCT {key}) + max(({key} IS NULL)::INT), 0))::BIGINT AS {out} FROM {table}"""


SQL = {
    "population_by_state": "SELECT Stab AS stab, sum(Males)::BIGINT AS males, sum(Females)::BIGINT AS females FROM bk_zip_census GROUP BY ALL",
    "foreign_born_by_county": "SELECT Stab AS stab, County AS county, sum(FBEurope)::BIGINT AS european_born FROM bk_zip_census GROUP BY ALL",
    "avg_price_by_group": f"""
FROM (SELECT GroupName AS group_name, {_MEAN} AS mean FROM bk_products GROUP BY ALL) SELECT group_name, round(mean, 6) AS average_price WHERE mean > 949""",
    # the groups, and all of them together as one more
    "price_rollup": f"""
SELECT group_name, min(FullPrice) AS min_price, max(FullPrice) AS max_price, round({_MEAN}, 6) AS avg_price
FROM (SELECT FullPrice, unnest([GroupName, 'Total']) AS group_name FROM bk_products WHERE GroupName <> '#N/A') GROUP BY ALL""",
    "product_vs_overall_avg": """
SELECT ProductId AS product_id, FullPrice AS full_price, round(sum(FullPrice) OVER ()::DOUBLE / count(FullPrice) OVER (), 6) AS average_full_price FROM bk_products""",
    "customer_orders": f"SELECT {_CUSTOMER}, {_ORDER} FROM bk_orders o, bk_customers c WHERE o.CustomerId = c.CustomerId",
    "all_orders_with_customer": f"SELECT {_CUSTOMER}, {_ORDER} FROM bk_orders o LEFT JOIN bk_customers c USING (CustomerId)",
    # an order's areas as a list: one row for each, or one without
    "orders_with_state": """
SELECT OrderId AS order_id, ZipCode AS zip_code, unnest(coalesce(s, [NULL])) AS stab
FROM bk_orders LEFT JOIN (SELECT zcta5, list(Stab) AS s FROM bk_zip_census GROUP BY ALL) ON zcta5 = ZipCode""",
    "state_orders_x_channel_campaigns": """
WITH o AS (FROM bk_orders WHERE State = 'S03'), c AS (FROM bk_campaigns WHERE Channel = 'WEB')
SELECT OrderId AS order_id, CustomerId AS customer_id, City AS city, (SELECT any_value(Discount) FROM c WHERE c.CampaignId = o.CampaignId) AS discount FROM o
UNION ALL BY NAME
SELECT Discount AS discount FROM c WHERE NOT EXISTS (FROM o WHERE o.CampaignId = c.CampaignId)""",
    "in_stock_value_by_group": """
SELECT GroupName AS group_name, sum(FullPrice) FILTER (IsInStock = 'Y')::DECIMAL(38,2) AS total_full_price
FROM bk_products GROUP BY ALL HAVING GroupName <> '#N/A' AND count(*) FILTER (IsInStock = 'Y') > 0""",
    "avg_orders_per_zip": _mean_of_counts("count(*)", "bk_orders", "ZipCode", "average_zip_code_order"),
    "avg_state_population": _mean_of_counts("sum(TotPop)", "bk_zip_census", "Stab", "average_state_population"),
    "max_order_by_customer": """
SELECT CustomerId AS customer_id, arg_max(total, total)::DECIMAL(38,2) AS total_price_customer
FROM (SELECT CustomerId, OrderId, sum(l.TotalPrice) AS total FROM bk_orders JOIN bk_order_lines l USING (OrderId) GROUP BY ALL)
WHERE CustomerId <> 0 GROUP BY ALL""",
    "orders_by_month_name": """
SELECT MonthAbbr AS month, sum(n)::BIGINT AS number_of_orders
FROM bk_calendar JOIN (SELECT OrderDate AS "Date", count(*) AS n FROM bk_orders GROUP BY ALL) USING ("Date") GROUP BY ALL""",
}
