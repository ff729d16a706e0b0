"""DuckDB texts for classification models and state signatures.

The most frequent label of a key is the greatest (count, label order) of its counts.
"""

_HIGH = "avg((p > 250000 AND p IS NOT NULL)::INTEGER::DOUBLE)"


def _top(rows: str, key: str, label: str) -> str:
    """(k, l): the most frequent label of each key, the smallest of equally frequent ones."""
    return f"""SELECT k, first(l ORDER BY n DESC, l) AS l
  FROM (SELECT {key} AS k, {label} AS l, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY k"""


def _lookup(rows: str, key: str, label: str, values: list, names: list[str], predicted: str) -> str:
    cells = ",\n  ".join(f"nullif(count(*) FILTER (b.l = {v!r}), 0) AS {n}" for v, n in zip(values, names))
    return f"""
WITH r AS ({rows}),
a AS ({_top("r WHERE NOT later", key, label)}),
b AS ({_top("r WHERE later", key, label)})
SELECT a.l AS {predicted},
  {cells}
FROM a JOIN b USING (k) GROUP BY a.l"""


_LATER = "(OrderDate >= DATE '2000-01-01') AS later"
_SOLD = f"""SELECT ProductId, (isodow(OrderDate) % 7 + 1)::BIGINT AS dow, if(isodow(OrderDate) >= 6, 'Weekend', 'Weekday') AS part, {_LATER}
  FROM bk_order_lines JOIN bk_orders USING (OrderId) WHERE OrderDate IN (SELECT "Date" FROM bk_calendar)"""
_EARLY = "(SELECT * FROM bk_orders WHERE OrderDate < DATE '2000-01-01')"
_PAYMENT = _top(_EARLY, "State", "PaymentType")
_GROUP = _top(f"{_EARLY} JOIN bk_order_lines USING (OrderId) JOIN bk_products USING (ProductId)", "State", "GroupName")
_ORDERS = f"""SELECT State AS state, count(*) AS n_orders, sum(TotalPrice)::DECIMAL(38,2) AS total_price,
  round(sum(TotalPrice)::DOUBLE / count(TotalPrice), 6) AS avg_price, count(HouseholdId) AS n_household_ids
FROM {_EARLY} JOIN bk_customers USING (CustomerId) GROUP BY State"""
_CAMPAIGN = """(SELECT Channel AS c, if(PaymentType IN ('??', 'OC'), 'Other', PaymentType) AS t, TotalPrice AS p
      FROM bk_orders JOIN bk_campaigns USING (CampaignId) WHERE year(OrderDate) = 1999)"""

SQL = {
    "high_order_probability": f"""
SELECT c AS channel, round({_HIGH}, 6) AS high_probability, count(*) FILTER (p > 250000) AS n_high,
  count(*) - count(*) FILTER (p > 250000) AS n_not_high
FROM {_CAMPAIGN} GROUP BY c""",
    "naive_bayes": f"""
WITH s AS (SELECT c, t, {_HIGH} AS h, grouping(c) AS all_c, grouping(t) AS all_t FROM {_CAMPAIGN} GROUP BY CUBE (c, t))
SELECT x.c AS channel, round(x.h, 6) AS p_channel, y.t AS payment_type, round(y.h, 6) AS p_payment, round(o.h, 6) AS p_overall,
  round(x.h * y.h / nullif(o.h, 0), 6) AS p_predicted, round(z.h, 6) AS p_actual
FROM s z JOIN s x ON x.c = z.c AND x.all_t = 1 AND x.all_c = 0 JOIN s y ON y.t = z.t AND y.all_c = 1 AND y.all_t = 0
JOIN s o ON o.all_c = 1 AND o.all_t = 1
WHERE z.all_c = 0 AND z.all_t = 0""",
    "lookup_product_dow": _lookup(_SOLD, "ProductId", "dow", list(range(1, 8)), [f"d{i}" for i in range(1, 8)], "predicted_dow"),
    "lookup_product_week": _lookup(_SOLD, "ProductId", "part", ["Weekday", "Weekend"], ["weekday", "weekend"], "predicted_week"),
    "lookup_zip_payment": _lookup(f"SELECT ZipCode, PaymentType, {_LATER} FROM bk_orders WHERE PaymentType NOT IN ('OC', '??')",
                                  "ZipCode", "PaymentType", ["AE", "DB", "MC", "VI"], ["ae", "db", "mc", "vi"], "predicted_payment"),
    "state_top_payment": f"SELECT k AS state, l AS payment_type FROM ({_PAYMENT})",
    "state_top_group": f"SELECT k AS state, l AS group_name FROM ({_GROUP})",
    "state_orders": _ORDERS,
    "state_signature": f"""
SELECT o.*, p.l AS top_payment, g.l AS top_group, DATE '2000-01-01' AS cutoff_date
FROM ({_ORDERS}) o JOIN ({_PAYMENT}) p ON p.k = state JOIN ({_GROUP}) g ON g.k = state WHERE state <> ''""",
    "three_years_of_sales": """
SELECT State AS state, (sum(TotalPrice) FILTER (year(OrderDate) = 1998))::DECIMAL(38,2) AS y_minus_2,
  (sum(TotalPrice) FILTER (year(OrderDate) = 1999))::DECIMAL(38,2) AS y_minus_1,
  (sum(TotalPrice) FILTER (year(OrderDate) = 2000))::DECIMAL(38,2) AS y
FROM bk_orders GROUP BY state""",
}
