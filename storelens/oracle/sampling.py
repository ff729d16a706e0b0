"""DuckDB oracle texts for sampling and value models."""

from storelens.oracle.parameterised import seeded

_PRODUCT = "ProductId AS product_id, GroupName AS group_name, IsInStock AS is_in_stock, FullPrice AS full_price"
#: Orders of 2000 above the limit, on days of the calendar.
_BIG = """(SELECT OrderId AS order_id, OrderDate AS order_date, TotalPrice AS total_price, DOWint % 7 <= 1 AS free
  FROM bk_orders JOIN bk_calendar ON "Date" = OrderDate WHERE "Date" BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND TotalPrice > 250000)"""
_SPLIT = "order_id, order_date, total_price, if(free, total_price, NULL) AS weekend, if(free, NULL, total_price) AS not_weekend"
_WOMEN = "bk_orders WHERE CustomerId IN (SELECT CustomerId FROM bk_customers WHERE Gender = 'F')"
_MEAN = "sum(TotalPrice)::DOUBLE / count(TotalPrice)"


def _predicted(dims: str, channel: bool) -> str:
    """The orders of 2000 by women, each with the mean of its cell's orders of 1999 (the mean of all, if the cell has none)."""
    known = "CampaignId IN (SELECT CampaignId FROM bk_campaigns)" if channel else "true"
    return f"""(SELECT OrderId, TotalPrice AS score, CASE WHEN {' AND '.join(f'{d} IS NOT NULL' for d in dims.split(', '))} THEN coalesce(cell, everywhere) ELSE everywhere END AS model
  FROM (SELECT *, sum(if(y = 1999 AND {known}, TotalPrice, NULL)) OVER here::DOUBLE / nullif(count(if(y = 1999 AND {known}, TotalPrice, NULL)) OVER here, 0) AS cell,
          sum(if(y = 1999, TotalPrice, NULL)) OVER ()::DOUBLE / nullif(count(if(y = 1999, TotalPrice, NULL)) OVER (), 0) AS everywhere
        FROM (SELECT *, year(OrderDate) AS y FROM {_WOMEN} AND year(OrderDate) IN (1999, 2000)){' LEFT JOIN bk_campaigns USING (CampaignId)' if channel else ''}
        WINDOW here AS (PARTITION BY {dims}))
  WHERE y = 2000 AND {known})"""


def _value_model(dims: str, channel: bool = False) -> str:
    return f"""
SELECT round(sum(score)::DOUBLE / count(score), 6) AS avg_score, round(avg(model), 6) AS avg_model FROM {_predicted(dims, channel)}"""


SQL = {
    # a row is kept if few enough come before it
    "sample_top_percent": f"""
SELECT guid, CampaignId AS campaign_id, Channel AS channel, Discount AS discount
FROM (SELECT *, {seeded('CampaignId')} AS guid FROM bk_campaigns)
QUALIFY rank() OVER (ORDER BY guid, CampaignId) - 1 < 0.1 * count(*) OVER ()""",
    "sample_hash_percent": f"FROM bk_subscribers WHERE left({seeded('SubscriberId')}, 6) < '19999a'",
    "sample_repeated": f"""
SELECT rank() OVER (ORDER BY ProductId)::BIGINT AS row_number, {_PRODUCT} FROM bk_products
QUALIFY (79 * rank() OVER (ORDER BY ProductId) + 19) % 100 BETWEEN 0 AND 9""",
    "group_share": """
SELECT GroupName AS group_name, count(*) AS group_total, sum(count(*)) OVER ()::BIGINT AS total, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 2) AS share
FROM bk_products GROUP BY ALL""",
    "sample_stratified": f"""
SELECT rank() OVER (ORDER BY GroupName, ProductId)::BIGINT AS row_number, {_PRODUCT} FROM bk_products
QUALIFY rank() OVER (ORDER BY GroupName, ProductId) % 100 = 3""",
    "big_orders_weekend_split": f"SELECT {_SPLIT} FROM {_BIG}",
    # the fifty smallest digests of both kinds as two lists
    "sample_balanced": f"""
SELECT {_SPLIT} FROM {_BIG} JOIN (
  SELECT unnest(list(order_id ORDER BY {seeded('order_id')}, order_id)[:50]) AS order_id FROM {_BIG} GROUP BY free) USING (order_id)""",
    "avg_price_by_year": f"""
SELECT year(OrderDate)::BIGINT AS year, round({_MEAN}, 6) AS average_total_price FROM {_WOMEN} AND year(OrderDate) BETWEEN 1999 AND 2000 GROUP BY ALL""",
    "value_model_state": _value_model("State"),
    "value_model_zip": _value_model("ZipCode"),
    "value_model_payment": _value_model("PaymentType"),
    "value_model_channel": _value_model("Channel", channel=True),
    "value_model_channel_payment": _value_model("Channel, PaymentType", channel=True),
    "avg_price_all_years": f"SELECT year(OrderDate)::BIGINT AS year, round({_MEAN}, 6) AS average_total_price FROM {_WOMEN} GROUP BY ALL",
    # tiles from the place and the number of rows: the first (rows mod 10) tiles have one row more
    "value_chart": f"""
SELECT if(place < (n % 10) * (n // 10 + 1), place // (n // 10 + 1), n % 10 + (place - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1))::BIGINT + 1 AS decile,
  round(avg(model), 6) AS avg_model, round(sum(score)::DOUBLE / count(score), 6) AS avg_score
FROM (SELECT *, rank() OVER (ORDER BY model DESC, OrderId) - 1 AS place, count(*) OVER () AS n FROM {_predicted('Channel, PaymentType', True)})
GROUP BY ALL""",
}
