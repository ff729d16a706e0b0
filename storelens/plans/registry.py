"""One entry per analytics key: the plan function and its fixture parameters.

Parameter values are the fixture literals of FIXTURES.md part C; the oracle
texts in ``storelens.oracle`` use the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import datetime as dt

from storelens.plans import classify as s9
from storelens.plans import conditionals as s2
from storelens.plans import location as s5
from storelens.plans import parameterised as s6
from storelens.plans import probability as s7
from storelens.plans import quality as s3
from storelens.plans import sampling as s8
from storelens.plans import summaries as s1
from storelens.plans import windows as s4
from storelens.sources.tables import Tables, load_tables

Entry = tuple[Callable[..., DataFrame], dict]

_MODEL = {"model_year": 1999, "score_year": 2000, "gender": "F"}
_CUTOFF = dt.date(2000, 1, 1)

ENTRIES: dict[str, Entry] = {
    # summaries, joins, CTEs
    "population_by_state": (s1.population_by_state, {}),
    "foreign_born_by_county": (s1.foreign_born_by_county, {}),
    "avg_price_by_group": (s1.avg_price_by_group, {"min_avg": 949.0}),
    "price_rollup": (s1.price_rollup, {}),
    "product_vs_overall_avg": (s1.product_vs_overall_avg, {}),
    "customer_orders": (s1.customer_orders, {}),
    "all_orders_with_customer": (s1.all_orders_with_customer, {}),
    "orders_with_state": (s1.orders_with_state, {}),
    "state_orders_x_channel_campaigns": (s1.state_orders_x_channel_campaigns,
                                         {"state": "S03", "channel": "WEB"}),
    "in_stock_value_by_group": (s1.in_stock_value_by_group, {}),
    "avg_orders_per_zip": (s1.avg_orders_per_zip, {}),
    "avg_state_population": (s1.avg_state_population, {}),
    "max_order_by_customer": (s1.max_order_by_customer, {}),
    "orders_by_month_name": (s1.orders_by_month_name, {}),
    # conditionals and pivots
    "gender_flags": (s2.gender_flags, {}),
    "gender_percentages": (s2.gender_percentages, {}),
    "sales_by_payment_label": (s2.sales_by_payment_label, {}),
    "orders_by_state_min": (s2.orders_by_state_min, {"min_orders": 500}),
    "first_shipment_volume": (s2.first_shipment_volume, {"years": (1996, 1997, 1998)}),
    "order_count_by_channel_pivot": (s2.order_count_by_channel_pivot, {}),
    "weekend_order_flag": (s2.weekend_order_flag, {}),
    "weekend_share_by_state": (s2.weekend_share_by_state, {}),
    "orders_by_price_band": (s2.orders_by_price_band, {"edges": (0, 10000, 50000, 100000, 400000)}),
    "subscriber_loyalty_years": (s2.subscriber_loyalty_years,
                                 {"max_id": 10000, "as_of": dt.date(2001, 12, 31)}),
    "first_year_performance": (s2.first_year_performance, {"years": (1997, 1998, 1999, 2000)}),
    "avg_price_state_payment_pivot": (s2.avg_price_state_payment_pivot, {}),
    # windows
    "state_population_rank": (s4.state_population_rank, {}),
    "county_rank_variants": (s4.county_rank_variants, {"state": "S04"}),
    "price_quartiles": (s4.price_quartiles, {"group": "LARGE"}),
    "top_decile_customers": (s4.top_decile_customers, {"state": "S04", "years": (1997, 1998)}),
    "order_summary_by_year": (s4.order_summary_by_year, {}),
    "fee_dispersion_by_plan": (s4.fee_dispersion_by_plan, {"max_id": 10000}),
    "month_vs_first_year": (s4.month_vs_first_year, {"years": (1996, 1997, 1998)}),
    "new_subscribers_vs_last_plan": (s4.new_subscribers_vs_last_plan, {"years": (1996, 1997, 1998, 1999)}),
    "best_sellers_prev_next": (s4.best_sellers_prev_next, {"k": 10, "exclude": ("#N/A", "PROMO")}),
    "county_population_distribution": (s4.county_population_distribution, {"states": ("S05", "S03")}),
    "median_order_by_month": (s4.median_order_by_month, {}),
    # referential checks and repairs
    "zip_keys_unmatched": (s3.zip_keys_unmatched, {}),
    "zip_county_orphans": (s3.zip_county_orphans, {}),
    "zip_county_repaired": (s3.zip_county_repaired, {}),
    "zip_census_orphans": (s3.zip_census_orphans, {}),
    "zip_census_repaired": (s3.zip_census_repaired, {}),
    "orders_unknown_zip": (s3.orders_unknown_zip, {}),
    "orders_repaired": (s3.orders_repaired, {}),
    "order_lines_orphans": (s3.order_lines_orphans, {}),
    "order_lines_repaired": (s3.order_lines_repaired, {}),
    "orders_unknown_customer": (s3.orders_unknown_customer, {}),
    "customers_with_placeholder": (s3.customers_with_placeholder, {}),
    # probabilities and odds
    "odds_payment_oc": (s7.odds_payment, {"types": ("OC",)}),
    "odds_payment_oc_mc": (s7.odds_payment, {"types": ("OC", "MC")}),
    "odds_payment_db": (s7.odds_payment, {"types": ("DB",), "base": ("DB", "MC", "VI", "AE")}),
    "share_by_payment": (s7.share_by_payment, {}),
    "share_by_gender": (s7.share_by_gender, {}),
    "share_by_weekday": (s7.share_by_weekday, {}),
    "share_by_channel": (s7.share_by_channel, {}),
    "product_gender_share": (s7.product_gender_share, {"group": "SMALL"}),
    "state_population_share": (s7.state_population_share, {}),
    "commute_shares": (s7.commute_shares, {"states": ("S01", "S02", "S03", "S04")}),
    "share_by_price_band": (s7.share_by_price_band, {"edges": (0, 10000, 50000, 100000, 400000)}),
    "foreign_born_share": (s7.foreign_born_share, {"zips": ("000001", "000002", "000003")}),
    "age_shares": (s7.age_shares, {"state": "S06"}),
    # location
    "areas_million_homes": (s5.areas_million_homes, {}),
    "areas_with_orders": (s5.areas_with_orders, {}),
    "foreign_born_split": (s5.foreign_born_split, {}),
    "top_payment_points": (s5.top_payment_points, {}),
    "customers_by_location": (s5.customers_by_location, {}),
    "work_at_home_share": (s5.work_at_home_share, {}),
    "top_sales_zip_by_state": (s5.top_sales_zip_by_state, {}),
    "top_customer_zip_by_state": (s5.top_customer_zip_by_state, {}),
    "low_income_placemarks": (s5.low_income_placemarks, {}),
    "top_customer_placemarks": (s5.top_customer_placemarks, {}),
    "distance_to_state_reference_sphere": (s5.distance_to_state_reference, {"metric": "sphere"}),
    "distance_to_state_reference_ellipsoid": (s5.distance_to_state_reference, {"metric": "ellipsoid"}),
    "areas_within_of_most_populated_sphere": (s5.areas_within_of_most_populated, {"metric": "sphere"}),
    "areas_within_of_most_populated_ellipsoid": (s5.areas_within_of_most_populated, {"metric": "ellipsoid"}),
    # parameterised functions, two calls each as in the reference
    "orders_with_delay": (s6.orders_with_delay, {"days": 10}),
    "orders_with_delay_2": (s6.orders_with_delay, {"days": 100}),
    "count_orders_with_delay": (s6.count_orders_with_delay, {"days": 10}),
    "count_orders_with_delay_2": (s6.count_orders_with_delay, {"days": 100}),
    "top_products": (s6.top_products, {"n": 10}),
    "top_products_2": (s6.top_products, {"n": 15}),
    "areas_other_language": (s6.areas_other_language, {"limit": 0.66}),
    "areas_other_language_2": (s6.areas_other_language, {"limit": 2.0 / 3}),
    "areas_closest_in_size": (s6.areas_closest_in_size, {"area": 34.02, "n": 10}),
    "areas_closest_in_size_2": (s6.areas_closest_in_size, {"area": 154.54, "n": 20}),
    "customers_by_purchase": (s6.customers_by_purchase, {"lo": 1963.00, "hi": 39950.00}),
    "customers_by_purchase_2": (s6.customers_by_purchase, {"lo": 5678.99, "hi": 9876.54}),
    "areas_named_like": (s6.areas_named_like, {"text": "brand#1"}),
    "areas_named_like_2": (s6.areas_named_like, {"text": "BRAND#2"}),
    "active_subscribers": (s6.active_subscribers, {"cutoff": dt.date(1999, 10, 12)}),
    "active_subscribers_2": (s6.active_subscribers, {"cutoff": dt.date(2005, 10, 12)}),
    "areas_around_point": (s6.areas_around_point, {"lat": 37.25, "lon": -92.51, "radius": 100}),
    "areas_around_point_2": (s6.areas_around_point, {"lat": 37.25, "lon": -92.51, "radius": 300}),
    "state_info": (s6.state_info, {"state": "S07"}),
    "state_info_2": (s6.state_info, {"state": "S08"}),
    "customers_per_month": (s6.customers_per_month, {"year": 1996}),
    "customers_per_month_2": (s6.customers_per_month, {"year": 1997}),
    # sampling and value models
    "sample_top_percent": (s8.sample_top_percent, {"pct": 10.0, "seed": "42"}),
    "sample_hash_percent": (s8.sample_hash_percent, {"pct": 10.0, "seed": "42"}),
    "sample_repeated": (s8.sample_repeated, {"mult": 79, "add": 19, "pct": 10}),
    "group_share": (s8.group_share, {}),
    "sample_stratified": (s8.sample_stratified, {"step": 100, "offset": 3}),
    "big_orders_weekend_split": (s8.big_orders_weekend_split, {"year": 2000, "min_price": 250000.0}),
    "sample_balanced": (s8.sample_balanced, {"k": 50, "year": 2000, "min_price": 250000.0, "seed": "42"}),
    "avg_price_by_year": (s8.avg_price_by_year, {"gender": "F", "years": (1999, 2000)}),
    "value_model_state": (s8.value_model, {"dims": ("State",), **_MODEL}),
    "value_model_zip": (s8.value_model, {"dims": ("ZipCode",), **_MODEL}),
    "value_model_payment": (s8.value_model, {"dims": ("PaymentType",), **_MODEL}),
    "value_model_channel": (s8.value_model, {"dims": ("Channel",), **_MODEL}),
    "value_model_channel_payment": (s8.value_model, {"dims": ("Channel", "PaymentType"), **_MODEL}),
    "avg_price_all_years": (s8.avg_price_all_years, {"gender": "F"}),
    "value_chart": (s8.value_chart, {"dims": ("Channel", "PaymentType"), "buckets": 10, **_MODEL}),
    # classification models and state signatures
    "high_order_probability": (s9.high_order_probability, {"year": 1999, "limit": 250000.0}),
    "naive_bayes": (s9.naive_bayes, {"year": 1999, "limit": 250000.0}),
    "lookup_product_dow": (s9.lookup_product_dow, {"split": _CUTOFF}),
    "lookup_product_week": (s9.lookup_product_week, {"split": _CUTOFF}),
    "lookup_zip_payment": (s9.lookup_zip_payment, {"split": _CUTOFF}),
    "state_top_payment": (s9.state_top_payment, {"cutoff": _CUTOFF}),
    "state_top_group": (s9.state_top_group, {"cutoff": _CUTOFF}),
    "state_orders": (s9.state_orders, {"cutoff": _CUTOFF}),
    "state_signature": (s9.state_signature, {"cutoff": _CUTOFF}),
    "three_years_of_sales": (s9.three_years_of_sales, {"cutoff": _CUTOFF}),
}


def export_types(df: DataFrame) -> DataFrame:
    """Uniform result types at the query boundary: integers as BIGINT, decimals
    as DOUBLE (sums are exact decimals up to this cast), dates as TIMESTAMP_NTZ
    at midnight (the type the source tables store dates in).  Library
    functions keep their natural types; only ``queries()`` results pass here."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        else:
            out.append(c)
            continue
        out.append(c.alias(f.name))
    return df.select(*out)


def run(key: str, spark: SparkSession, sf_dir: str, tables: Tables | None = None,
        export: bool = True) -> DataFrame:
    fn, params = ENTRIES[key]
    df = fn(tables or load_tables(spark, sf_dir), **params)
    return export_types(df) if export else df


def query_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(key: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(key, spark, sf_dir)
    return {k: bind(k) for k in ENTRIES}
