"""DuckDB texts for ranking and window analyses.

Written without the window function that is under test where counting gives the same:
a rank is one more than the number of rows ahead, a neighbour is the best row behind.
"""

_YEARS = "year(d) BETWEEN {} AND {} AND d IN (SELECT \"Date\" FROM bk_calendar)"

SQL = {
    "state_population_rank": """
WITH s AS (SELECT Stab AS state, sum(TotPop)::BIGINT AS total_pop FROM bk_zip_census GROUP BY ALL)
SELECT a.state, a.total_pop, count(*) AS population_rank
FROM s a JOIN s b ON (b.total_pop, b.state) <= (a.total_pop, a.state) GROUP BY ALL""",
    "county_rank_variants": """
WITH s AS (SELECT coalesce(County, '') AS k, any_value(County) AS county, sum(FBEurope)::BIGINT AS n
           FROM bk_zip_census WHERE Stab = 'S04' GROUP BY 1 HAVING n > 0)
SELECT a.county, a.n AS european_born, count(*) FILTER ((b.n, b.k) <= (a.n, a.k)) AS sequence,
  1 + count(*) FILTER (b.n < a.n) AS rank, 1 + count(DISTINCT b.n) FILTER (b.n < a.n) AS no_gap_rank
FROM s a, s b GROUP BY a.k, a.county, a.n""",
    "price_quartiles": """
WITH s AS (SELECT list(struct_pack(m := -FullPrice, i := ProductId) ORDER BY -FullPrice, ProductId) AS rows
           FROM bk_products WHERE GroupName = 'LARGE' AND IsInStock = 'Y'),
n AS (SELECT rows, len(rows) AS n, unnest(range(len(rows))) AS pos FROM s)
SELECT rows[pos + 1].i AS product_id, -rows[pos + 1].m AS full_price,
  CASE WHEN pos < n % 4 * (n // 4 + 1) THEN pos // (n // 4 + 1) + 1
       ELSE n % 4 + (pos - n % 4 * (n // 4 + 1)) // (n // 4) + 1 END AS quartile
FROM n""",
    "top_decile_customers": """
WITH s AS (SELECT year(OrderDate) AS y, CustomerId AS c, sum(TotalPrice)::DECIMAL(38,2) AS p
           FROM bk_orders WHERE State = 'S04' AND CustomerId <> 0 AND year(OrderDate) IN (1997, 1998) GROUP BY ALL),
g AS (SELECT y, list(struct_pack(m := -p, c := c) ORDER BY -p, c) AS rows FROM s GROUP BY y),
first AS (SELECT y, unnest(rows[:(len(rows) + 9) // 10]) AS r FROM g)
SELECT y::BIGINT AS year_order, r.c AS customer, -r.m AS total_price FROM first""",
    "order_summary_by_year": """
SELECT y::BIGINT AS year_order, lo AS min_price, hi AS max_price, round(total::DOUBLE / n, 2) AS avg_price,
  total AS sum_price, n AS count_order, n AS count_big_order
FROM (SELECT year(OrderDate) AS y, min(TotalPrice) AS lo, max(TotalPrice) AS hi, sum(TotalPrice)::DECIMAL(38,2) AS total,
             count(*) AS n FROM bk_orders WHERE TotalPrice <> 0 GROUP BY y)""",
    "fee_dispersion_by_plan": """
SELECT RatePlan AS rate_plan, round(sum(MonthlyFee)::DOUBLE / count(*), 2) AS avg_fee,
  round(var_samp(MonthlyFee), 2) AS var_fee, round(var_pop(MonthlyFee), 2) AS varp_fee,
  round(stddev_samp(MonthlyFee), 2) AS stdev_fee, round(stddev_pop(MonthlyFee), 2) AS stdevp_fee
FROM bk_subscribers WHERE SubscriberId < 10000 GROUP BY rate_plan""",
    "month_vs_first_year": f"""
WITH s AS (SELECT year(d)::BIGINT AS y, month(d) AS m, strftime(d, '%b') AS name, sum(p)::DECIMAL(38,2) AS total
           FROM (SELECT OrderDate AS d, TotalPrice AS p FROM bk_orders) WHERE {_YEARS.format(1996, 1998)} GROUP BY ALL),
f AS (SELECT m, arg_min(total, y) AS first FROM s GROUP BY m)
SELECT y AS order_year, name AS month_abbr, total AS sum_price, first AS first_value, (total - first)::DECIMAL(38,2) AS gap
FROM s JOIN f USING (m)""",
    "new_subscribers_vs_last_plan": f"""
WITH s AS (SELECT year(d)::BIGINT AS y, plan, count(*) AS n
           FROM (SELECT StartDate AS d, RatePlan AS plan FROM bk_subscribers) WHERE {_YEARS.format(1996, 1999)} GROUP BY ALL),
f AS (SELECT y, arg_max(n, plan) AS last FROM s GROUP BY y)
SELECT y AS subs_year, plan AS rate_plan, n AS subs_num, last AS last_value, last - n AS gap FROM s JOIN f USING (y)""",
    "best_sellers_prev_next": """
WITH sold AS (SELECT ProductId AS i, sum(TotalPrice)::DECIMAL(38,2) AS p FROM bk_order_lines GROUP BY i),
g AS (SELECT GroupName AS g, list(struct_pack(m := -p, i := i) ORDER BY -p, i)[:10] AS r
      FROM sold JOIN bk_products ON ProductId = i WHERE GroupName NOT IN ('#N/A', 'PROMO') GROUP BY g),
spots AS (SELECT g, r, unnest(range(1, len(r) + 1)) AS k FROM g)
SELECT g AS group_name, r[k].i AS product_id, -r[k].m AS sum_price,
  CASE WHEN k > 1 THEN -r[k - 1].m END AS prev_price, CASE WHEN k < len(r) THEN -r[k + 1].m END AS next_price
FROM spots""",
    "county_population_distribution": """
WITH s AS (SELECT Stab AS stab, County AS county, sum(TotPop)::BIGINT AS n FROM bk_zip_census
           WHERE Stab IN ('S03', 'S05') AND County IS NOT NULL GROUP BY ALL)
SELECT a.stab, a.county, a.n AS sum_pop,
  round(coalesce(count(*) FILTER (b.n < a.n) / nullif(count(*) - 1, 0)::DOUBLE, 0), 2) AS percent_rank,
  round(count(*) FILTER (b.n <= a.n) / count(*)::DOUBLE, 2) AS cume_dist
FROM s a JOIN s b USING (stab) GROUP BY a.stab, a.county, a.n""",
    "median_order_by_month": """
WITH s AS (SELECT year(OrderDate)::BIGINT AS year, month(OrderDate)::BIGINT AS month, strftime(OrderDate, '%b') AS month_abbr,
                  list(TotalPrice ORDER BY TotalPrice) AS v
           FROM bk_orders WHERE TotalPrice IS NOT NULL AND OrderDate IN (SELECT "Date" FROM bk_calendar) GROUP BY ALL)
SELECT year, month, month_abbr,
  round((v[(len(v) + 1) // 2]::DOUBLE + v[len(v) // 2 + 1]::DOUBLE) / 2, 4) AS percentile_cont,
  v[(len(v) + 1) // 2] AS percentile_disc
FROM s""",
}
