"""DuckDB texts for referential checks and repairs, written as set membership.

A repaired relation keeps the rows whose key is in the set of valid keys; an orphan
list is what is left of the relation without them.
"""

# keys in both the county and the census relation: what either keeps after its repair
_VALID = "valid AS (SELECT ZipCode AS z FROM bk_zip_county INTERSECT SELECT zcta5 FROM bk_zip_census)"
_KNOWN = _VALID + ",\nplaced AS (SELECT OrderId FROM bk_orders WHERE ZipCode IN (SELECT z FROM valid))"
_TAGGED = """
SELECT max(CASE side WHEN 'census' THEN z END) AS zcta5, max(CASE side WHEN 'county' THEN z END) AS zip_code
FROM (SELECT zcta5 AS z, 'census' AS side FROM bk_zip_census UNION ALL SELECT ZipCode, 'county' FROM bk_zip_county)
GROUP BY z HAVING count(DISTINCT side) = 1"""

SQL = {
    "zip_keys_unmatched": _TAGGED,
    "zip_county_orphans": """
SELECT CAST(NULL AS VARCHAR) AS zcta5, z AS zip_code
FROM (SELECT ZipCode AS z FROM bk_zip_county EXCEPT SELECT zcta5 FROM bk_zip_census)""",
    "zip_county_repaired": f"WITH {_VALID} SELECT z AS ZipCode FROM valid",
    "zip_census_orphans": """
SELECT z AS zcta5, CAST(NULL AS VARCHAR) AS zip_code
FROM (SELECT zcta5 AS z FROM bk_zip_census EXCEPT SELECT ZipCode FROM bk_zip_county)""",
    "zip_census_repaired": f"WITH {_VALID} SELECT * FROM bk_zip_census WHERE zcta5 IN (SELECT z FROM valid)",
    "orders_unknown_zip": f"""
WITH {_VALID} SELECT * FROM bk_orders a WHERE NOT EXISTS (SELECT 1 FROM valid WHERE z = a.ZipCode)""",
    "orders_repaired": f"WITH {_KNOWN} SELECT * FROM bk_orders WHERE OrderId IN (SELECT OrderId FROM placed)",
    "order_lines_orphans": f"""
WITH {_KNOWN} SELECT * FROM bk_order_lines a WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.OrderId = a.OrderId)""",
    "order_lines_repaired": f"""
WITH {_KNOWN} SELECT * FROM bk_order_lines WHERE OrderId IN (SELECT OrderId FROM placed)""",
    "orders_unknown_customer": f"""
WITH {_KNOWN}
SELECT CustomerId AS customer_id FROM bk_orders a
WHERE OrderId IN (SELECT OrderId FROM placed) AND CustomerId IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM bk_customers b WHERE b.CustomerId = a.CustomerId)""",
    "customers_with_placeholder": """
SELECT * FROM bk_customers UNION ALL BY NAME
SELECT 0 AS CustomerId, 0 AS HouseholdId, ' ' AS Gender, ' ' AS FirstName""",
}
