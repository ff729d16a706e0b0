"""DuckDB oracle texts for probabilities and odds: conditional aggregates, and windows over the grouped rows."""


def _odds(hit: str, base: str = "true") -> str:
    """The share of the orders in ``base`` with ``hit``, and its odds, from one aggregate."""
    return f"""
SELECT round(n / nullif(of, 0), 2) AS probability, round((n / nullif(of, 0)) / nullif(1 - n / nullif(of, 0), 0), 2) AS odds
FROM (SELECT (count(OrderId) FILTER ({hit}))::DOUBLE AS n, count(OrderId) FILTER ({base}) AS of FROM bk_orders)"""


def _share(of: str, label: str, n: str, total: str, digits: int, counted: str = "count(*)") -> str:
    """Counted rows per label, their sum over all labels (a window over the grouped rows), and the share."""
    return f"""
SELECT {label}, {counted} AS {n}, sum({counted}) OVER ()::BIGINT AS {total}, round({counted} / (sum({counted}) OVER ())::DOUBLE, {digits}) AS probability
FROM {of} GROUP BY ALL"""


def _part(of: str, whole: str, digits: int = 2) -> str:
    return f"round(sum({of})::DOUBLE / nullif(sum({whole}), 0), {digits})"


# fixed values: the labels of the price bands and their upper bounds
_BANDS = (("Under $10000", 10000), ("Under $50000", 50000), ("Under $100000", 100000), ("Under $400000", 400000))
_LABELS = "[" + ", ".join(f"'{label}'" for label, _ in _BANDS) + "]"
_BOUNDS = "[" + ", ".join(str(bound) for _, bound in _BANDS) + "]"
# the band of a positive price is the first bound that is not below it; a list index outside the list is NULL
_BAND = (f"if(TotalPrice = 0, 'Free Orders', if(TotalPrice > 0, {_LABELS}[1 + len(list_filter({_BOUNDS}, lambda x: x < TotalPrice))], NULL))")

SQL = {
    "odds_payment_oc": _odds("PaymentType = 'OC'"),
    "odds_payment_oc_mc": _odds("PaymentType = 'OC' OR PaymentType = 'MC'"),
    "odds_payment_db": _odds("PaymentType = 'DB'", "PaymentType IN ('AE', 'DB', 'MC', 'VI')"),
    "share_by_payment": _share("bk_orders", "PaymentType AS payment_type", "nb", "total", 4, "count(OrderId)"),
    "share_by_gender": _share("bk_customers WHERE Gender = 'F' OR Gender = 'M'", "Gender AS gender", "total_gender", "total", 2),
    "share_by_weekday": _share("bk_calendar JOIN bk_orders ON OrderDate = \"Date\"",
                               "DOW AS dow, DOWint::BIGINT AS dow_int", "orders_per_day", "total", 2),
    "share_by_channel": _share("bk_campaigns JOIN bk_orders USING (CampaignId)", "Channel AS channel", "orders_per_channel", "total", 3),
    "product_gender_share": """
SELECT ProductId AS product_id, any_value(GroupName) AS group_name, count(*) FILTER (Gender = 'F') AS total_female,
  count(*) FILTER (Gender = 'M') AS total_male, count(*) AS total_mf,
  round(avg((Gender = 'F')::INT), 2) AS proba_female, round(avg((Gender = 'M')::INT), 2) AS proba_male
FROM bk_customers JOIN bk_orders USING (CustomerId) JOIN bk_order_lines USING (OrderId) JOIN bk_products USING (ProductId)
WHERE Gender IN ('F', 'M') AND GroupName = 'SMALL' GROUP BY ProductId""",
    "state_population_share": _share("bk_zip_census", "Stab AS stab", "state_pop", "country_pop", 3, "sum(TotPop)::BIGINT"),
    "commute_shares": f"""
SELECT Stab AS state, {_part('DriveAlone', 'Worker16')} AS drive_alone, {_part('Carpool', 'Worker16')} AS carpool,
  {_part('PublicTrans', 'Worker16')} AS public_trans, {_part('WalkToWork', 'Worker16')} AS walk,
  {_part('OtherCommute', 'Worker16')} AS other, {_part('WorkAtHome', 'Worker16')} AS work_at_home
FROM bk_zip_census GROUP BY Stab HAVING Stab BETWEEN 'S01' AND 'S04'""",
    "share_by_price_band": _share(f"(SELECT {_BAND} AS price_category, OrderId FROM bk_orders)", "price_category", "number_of_orders", "total", 3, "count(OrderId)"),
    "foreign_born_share": """
SELECT Stab AS stab, ZIPName AS zip_name, County AS county, FBMinusSea AS fb_minus_sea, TotPop AS tot_pop,
  if(TotPop = 0, NULL, round(FBMinusSea::DOUBLE / TotPop, 2)) AS probability
FROM bk_zip_census SEMI JOIN (VALUES ('000001'), ('000002'), ('000003')) wanted(z) ON zcta5 = z""",
    "age_shares": f"""
SELECT Stab AS stab, sum(TotPop)::BIGINT AS tot_pop, (sum(Under18) + sum(Over18) - sum(Over21))::BIGINT AS n_0_20,
  (sum(Over21) - sum(Over65))::BIGINT AS n_21_64, sum(Over65)::BIGINT AS n_65, {_part('Under18 + Over18 - Over21', 'TotPop')} AS p_0_20,
  {_part('Over21 - Over65', 'TotPop')} AS p_21_64, {_part('Over65', 'TotPop')} AS p_65
FROM bk_zip_census WHERE TotPop <> 0 GROUP BY Stab HAVING Stab = 'S06'""",
}
