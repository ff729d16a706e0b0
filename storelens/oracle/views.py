"""DuckDB text of the nine relations (same rules as ``sources.tables``).

The oracle only has the driver's raw tables, so each oracle query is prefixed
with the CTEs of the relations it names.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "bk_orders": """
SELECT o_orderkey AS OrderId,
  CASE WHEN o_custkey % 10 = 0 THEN CAST(0 AS BIGINT) ELSE o_custkey END AS CustomerId,
  o_custkey // 14 AS CampaignId, CAST(o_orderdate AS DATE) AS OrderDate,
  concat('City', CAST(z AS VARCHAR)) AS City,
  CASE WHEN o_orderkey % 200 = 0 THEN '' ELSE concat('S', lpad(CAST(z % 25 AS VARCHAR), 2, '0')) END AS State,
  lpad(CAST(z AS VARCHAR), 6, '0') AS ZipCode,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AE' WHEN '2-HIGH' THEN 'DB' WHEN '3-MEDIUM' THEN 'MC'
    WHEN '5-LOW' THEN 'VI' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '??' ELSE 'OC' END END AS PaymentType,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS TotalPrice
FROM (SELECT *, o_custkey % (o_custkey % 140 + 1) AS z FROM orders) t""",
    "bk_order_lines": """
SELECT l_orderkey * 8 + l_linenumber AS OrderLineId, l_orderkey AS OrderId, l_partkey AS ProductId,
  CAST(l_shipdate AS DATE) AS ShipDate, CAST(l_quantity AS INTEGER) AS NumUnits,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS TotalPrice
FROM lineitem""",
    "bk_products": """
SELECT p_partkey AS ProductId, CASE WHEN p_partkey % 50 = 0 THEN '#N/A' ELSE p_type END AS GroupName,
  CASE WHEN p_size % 3 = 0 THEN 'N' ELSE 'Y' END AS IsInStock,
  CAST(p_retailprice AS DECIMAL(12,2)) AS FullPrice
FROM part""",
    "bk_customers": """
SELECT c_custkey AS CustomerId, c_custkey % 400 AS HouseholdId,
  CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 <= 3 THEN 'F' ELSE 'M' END AS Gender,
  c_name AS FirstName
FROM customer WHERE c_custkey % 10 <> 0""",
    "bk_campaigns": """
SELECT s_suppkey AS CampaignId,
  CASE s_suppkey % 5 WHEN 0 THEN 'WEB' WHEN 1 THEN 'AD' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'REFERRAL'
    ELSE 'CATALOG' END AS Channel,
  CAST(s_nationkey % 4 * 5 AS INTEGER) AS Discount
FROM supplier""",
    "bk_subscribers": """
SELECT o_orderkey AS SubscriberId, o_orderpriority AS RatePlan,
  CAST(o_totalprice AS DECIMAL(12,2)) AS MonthlyFee, CAST(o_orderdate AS DATE) AS StartDate,
  CASE WHEN o_orderstatus = 'O' THEN NULL
    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) END AS StopDate
FROM orders""",
    "bk_zip_county": """
SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ZipCode FROM part WHERE p_partkey % 13 <> 0""",
    "bk_zip_census": """
SELECT lpad(CAST(p AS VARCHAR), 6, '0') AS zcta5, concat('State', CAST(p % 25 AS VARCHAR)) AS state,
  concat('S', lpad(CAST(p % 25 AS VARCHAR), 2, '0')) AS Stab,
  CASE WHEN p % 101 = 0 THEN NULL ELSE p_brand END AS County, p_name AS ZIPName,
  20 + CAST(p * 37 % 3500 AS DOUBLE) / 100 AS Latitude, -130 + CAST(p * 53 % 7000 AS DOUBLE) / 100 AS Longitude,
  CAST(p * 17 % 4000 AS DOUBLE) / 10 AS AreaSQMI,
  b * 480 AS Males, b * 500 AS Females, CASE WHEN b = 0 THEN CAST(0 AS BIGINT) ELSE b * 1000 + p * 7 % 1000 END AS TotPop,
  b * 1000 + p % 997 AS FBEurope, b * 10 * (p % 15) AS FBMinusSea, b * 10 * (p % 25) AS BornOutsideUS,
  b * 10 AS OwnerOcc, b * (p % 10) AS HvalOverMillion, b * 400 AS TotHHs, b * 4 * (p % 100) AS HHInc0,
  b * 500 AS Worker16, b * 5 * (p % 40) AS DriveAlone, b * 5 * (p % 20) AS Carpool,
  b * 5 * (p % 15) AS PublicTrans, b * 5 * (p % 10) AS WalkToWork, b * 5 * (p % 8) AS OtherCommute,
  b * (p % 20) AS WorkAtHome, b * 900 AS Over5, b * 9 * (p % 100) AS OthLang, b * 3 * (p % 30) AS Spanish,
  b * 240 AS Under18, b * 760 AS Over18, b * 700 AS Over21, b * (100 + p % 50) AS Over65
FROM (SELECT p_partkey AS p,
        CAST(CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size END AS BIGINT) AS b, p_brand, p_name
      FROM part WHERE p_partkey % 11 <> 0) t""",
    "bk_calendar": """
SELECT CAST(d AS DATE) AS "Date", year(d) AS Year, month(d) AS Month, strftime(d, '%b') AS MonthAbbr,
  strftime(d, '%a') AS DOW, dayofweek(d) + 1 AS DOWint
FROM (SELECT unnest(generate_series(DATE '1992-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS d) t
WHERE day(d) <> 31""",
}

_NAME = re.compile(r"\bbk_[a-z_]+\b")


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of the relations it references."""
    body = body.strip()
    used = [n for n in VIEWS if n in set(_NAME.findall(body))]
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in used)
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
