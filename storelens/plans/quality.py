"""Referential checks and repairs.

The reference deletes orphans in place, one relation after the other; here a
repair returns the corrected relation and the next check reads it, so the
whole chain is one lazy plan (``repair_pipeline``).  Orphan lists are
anti joins and repairs semi joins: neither duplicates rows nor materialises
the outer join the reference filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators.joins import skew_join
from storelens.sources.tables import Tables


def _nulls(name: str) -> F.Column:
    return F.lit(None).cast("string").alias(name)


def zip_keys_unmatched(t: Tables) -> DataFrame:
    zce, zco = t.zip_census.select("zcta5"), t.zip_county.select("ZipCode")
    # keys are near unique on both sides: one full join shuffles each side once
    both = zce.join(zco, zce.zcta5 == zco.ZipCode, "full").select("zcta5", F.col("ZipCode").alias("zip_code"))
    one_sided = F.col("zcta5").isNull() | F.col("zip_code").isNull()
    return both.where(one_sided).orderBy(F.asc_nulls_first("zcta5"), F.asc_nulls_first("zip_code"))


def repair_pipeline(t: Tables, stages: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Every check and repair of the script, each reading the previous repair
    (``stages`` limits the result to the named entries)."""
    census, county = t.zip_census, t.zip_county
    county_orphans = county.join(census, county.ZipCode == census.zcta5, "left_anti")
    county_ok = county.join(census, county.ZipCode == census.zcta5, "left_semi")
    census_orphans = census.join(county_ok, census.zcta5 == county_ok.ZipCode, "left_anti")
    census_ok = census.join(county_ok, census.zcta5 == county_ok.ZipCode, "left_semi")
    out = {
        "zip_county_orphans": county_orphans.select(_nulls("zcta5"), F.col("ZipCode").alias("zip_code"))
                                            .orderBy("zip_code"),
        "zip_county_repaired": county_ok,
        "zip_census_orphans": census_orphans.select("zcta5", _nulls("zip_code")).orderBy("zcta5"),
        "zip_census_repaired": census_ok,
    }
    wanted = set(stages or ORDER_STAGES + tuple(out))
    if wanted & set(ORDER_STAGES):
        zips = census_ok.select("zcta5")
        orders = t.orders
        orders_ok = orders.join(zips, orders.ZipCode == zips.zcta5, "left_semi")
        lines = t.order_lines
        out.update({
            "orders_unknown_zip": orders.join(zips, orders.ZipCode == zips.zcta5, "left_anti")
                                        .orderBy("ZipCode", "OrderId"),
            "orders_repaired": orders_ok,
            "order_lines_orphans": lines.join(orders_ok, "OrderId", "left_anti").orderBy("OrderId", "OrderLineId"),
            "order_lines_repaired": lines.join(orders_ok, "OrderId", "left_semi"),
            "orders_unknown_customer": not_in(orders_ok, "CustomerId", t.customers, "CustomerId")
                                       .select(F.col("CustomerId").alias("customer_id")),
        })
    return {k: v for k, v in out.items() if k in wanted}


ORDER_STAGES = ("orders_unknown_zip", "orders_repaired", "order_lines_orphans", "order_lines_repaired",
                "orders_unknown_customer")


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """``df.col NOT IN (SELECT other_col FROM other)`` with SQL NULL rules:
    no row at all if the list holds a NULL, no row whose value is NULL unless the list is empty.

    Written as a hash anti join plus a scalar "list has a NULL" flag instead
    of Spark's null-aware anti join, which needs a broadcastable list (else a
    nested loop join).
    """
    keys = other.select(F.col(other_col).alias(col))
    # 1: the list holds a NULL, 0: it does not, NULL: it is empty
    has_null = keys.agg(F.max(F.col(col).isNull().cast("int"))).scalar()
    anti = skew_join(df, keys, [col], "left_anti")
    return anti.where(has_null.isNull() | ((has_null == 0) & F.col(col).isNotNull()))


def _stage(key: str):
    def run(t: Tables) -> DataFrame:
        return repair_pipeline(t, (key,))[key]
    run.__name__ = key
    run.__doc__ = f"``repair_pipeline(t)['{key}']``"
    return run


zip_county_orphans = _stage("zip_county_orphans")
zip_county_repaired = _stage("zip_county_repaired")
zip_census_orphans = _stage("zip_census_orphans")
zip_census_repaired = _stage("zip_census_repaired")
orders_unknown_zip = _stage("orders_unknown_zip")
orders_repaired = _stage("orders_repaired")
order_lines_orphans = _stage("order_lines_orphans")
order_lines_repaired = _stage("order_lines_repaired")
orders_unknown_customer = _stage("orders_unknown_customer")

# Fixed value of the reference: the placeholder customer row.
PLACEHOLDER_CUSTOMER = (0, 0, " ", " ")


def customers_with_placeholder(t: Tables) -> DataFrame:
    c = t.customers
    schema = T.StructType([T.StructField("CustomerId", T.LongType()), T.StructField("HouseholdId", T.LongType()),
                           T.StructField("Gender", T.StringType()), T.StructField("FirstName", T.StringType())])
    extra = c.sparkSession.createDataFrame([PLACEHOLDER_CUSTOMER], schema)
    return c.unionByName(extra, allowMissingColumns=True)
