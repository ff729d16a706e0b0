"""DuckDB texts for conditional logic and pivots, as filtered aggregates and lookup lists."""

_SHARE = "round(100.0::DOUBLE * count(*) FILTER ({}) / count(*), 2)"
_BLANK = "length(rtrim(Gender)) <> 1"


def _avg(kind: str) -> str:
    some = f"FILTER (t = '{kind}')"
    return f"round(CAST(sum(p) {some} AS DOUBLE) / nullif(count(p) {some}, 0), 6) AS {kind.lower()}"


SQL = {
    "gender_flags": f"""
SELECT CustomerId AS customer_id, if(Gender = 'F', 100, 0)::BIGINT AS is_female, if(Gender = 'M', 100, 0)::BIGINT AS is_male,
  if({_BLANK}, 100, 0)::BIGINT AS is_unknown
FROM bk_customers""",
    "gender_percentages": f"""
SELECT {_SHARE.format("Gender = 'M'")} AS avg_male, {_SHARE.format("Gender = 'F'")} AS avg_female,
  {_SHARE.format(_BLANK)} AS avg_unknown
FROM bk_customers""",
    "sales_by_payment_label": """
WITH names(code, label) AS (VALUES ('AE', 'American Express'), ('DB', 'Debit'), ('MC', 'Mastercard'), ('VI', 'Visa'))
SELECT coalesce(label, 'Other') AS payment_type, sum(TotalPrice)::DECIMAL(38,2) AS sum_total_price
FROM bk_orders LEFT JOIN names ON code = PaymentType GROUP BY ALL""",
    "orders_by_state_min": """
SELECT coalesce((SELECT Stab FROM bk_zip_census WHERE zcta5 = z), 'Undefined ZipCode') AS stab, sum(n)::BIGINT AS number_of_orders
FROM (SELECT ZipCode AS z, count(*) AS n FROM bk_orders GROUP BY z) GROUP BY stab HAVING sum(n) >= 500""",
    "first_shipment_volume": """
SELECT i AS product_id, arg_min(n, y) AS first_shipment_volume
FROM (SELECT ProductId AS i, year(ShipDate) AS y, count(*) AS n FROM bk_order_lines WHERE y BETWEEN 1996 AND 1998 GROUP BY ALL)
GROUP BY i""",
    "order_count_by_channel_pivot": """
WITH n AS (SELECT Channel AS c, count(*) AS n FROM bk_orders JOIN bk_campaigns USING (CampaignId) GROUP BY c),
m AS (SELECT map_from_entries(list((c, n))) AS m FROM n)
SELECT 'Count' AS campaign_channel, coalesce(m['WEB'], 0) AS web, coalesce(m['AD'], 0) AS ad, coalesce(m['MAIL'], 0) AS mail,
  coalesce(m['REFERRAL'], 0) AS referral
FROM m""",
    "weekend_order_flag": """
SELECT OrderId AS order_id, if(isodow(OrderDate) >= 6, 100.0, 0.0)::DOUBLE AS weekend_order
FROM bk_orders WHERE OrderDate IN (SELECT "Date" FROM bk_calendar)""",
    "weekend_share_by_state": """
SELECT State AS state, round(100.0::DOUBLE * count(*) FILTER (isodow(OrderDate) >= 6) / count(*), 2) AS avg_weekend_order
FROM (SELECT * FROM bk_orders SEMI JOIN bk_calendar ON "Date" = OrderDate) o
WHERE EXISTS (SELECT 1 FROM bk_zip_census z WHERE z.Stab = o.State) GROUP BY ALL""",
    "orders_by_price_band": """
WITH bands(low, high, label) AS (VALUES (0, 10000, 'Under $10000'), (10000, 50000, 'Under $50000'),
  (50000, 100000, 'Under $100000'), (100000, 400000, 'Under $400000'))
SELECT if(TotalPrice = 0, 'Free Orders', label) AS price_category, count(*) AS number_of_orders
FROM bk_orders LEFT JOIN bands ON TotalPrice > low AND TotalPrice <= high GROUP BY ALL""",
    "subscriber_loyalty_years": """
SELECT year(coalesce(StopDate, DATE '2001-12-31')) - year(StartDate) AS loyalty_year, count(*) AS number_of_subscribers
FROM bk_subscribers WHERE SubscriberId < 10000 GROUP BY loyalty_year""",
    "first_year_performance": """
SELECT c AS channel, round(arg_min(a, y) FILTER (y BETWEEN 1997 AND 2000), 6) AS first_performance
FROM (SELECT Channel AS c, year(OrderDate) AS y, sum(TotalPrice)::DOUBLE / count(TotalPrice) AS a
      FROM bk_orders JOIN bk_campaigns USING (CampaignId) GROUP BY ALL)
GROUP BY c""",
    "avg_price_state_payment_pivot": f"""
SELECT Stab AS stab, {', '.join(map(_avg, ('AE', 'VI', 'DB', 'MC', 'OC')))}
FROM (SELECT Stab, replace(PaymentType, '??', 'OC') AS t, TotalPrice AS p FROM bk_zip_census JOIN bk_orders ON ZipCode = zcta5)
GROUP BY Stab""",
}
