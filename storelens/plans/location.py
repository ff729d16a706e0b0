"""Location, distance and map placemarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.geo import distance_miles, rad
from storelens.functions.semantics import concat_text, money_sum, pct
from storelens.operators.distinct import count_distinct
from storelens.operators.joins import spread_join
from storelens.operators.ranking import asc, mode_by_key, ranks
from storelens.operators.spatial import pairs_within
from storelens.sources.tables import Tables

# Fixed values of the reference: the continental box and the KML placemark pieces.
US_BOX = (24.0, 50.0, -125.0, -65.0)
KML_STYLE = "#icon-1899-0288D1"
CARD_COLUMNS = (("VI", "visa"), ("AE", "amex"), ("MC", "mastercard"), ("DB", "debit"))


def _in_box(box: Sequence[float] = US_BOX):
    lat0, lat1, lon0, lon1 = box
    return F.col("Latitude").between(lat0, lat1) & F.col("Longitude").between(lon0, lon1)


def _area_cols(state_alias: str = "state"):
    return [F.col("Stab").alias(state_alias), "zcta5", F.col("ZIPName").alias("zip_name"),
            F.col("County").alias("county"), F.col("Longitude").alias("longitude"),
            F.col("Latitude").alias("latitude")]


def placemark(name: F.Column, zcta5: F.Column, description: F.Column, lon: F.Column, lat: F.Column) -> F.Column:
    return concat_text("<Placemark><name>", name, " (", zcta5, ")</name>", "<description>", description,
                       "</description>", f"<styleUrl>{KML_STYLE}</styleUrl>", "<Point><coordinates>",
                       lon, ",", lat, ",", F.lit(0), "</coordinates></Point></Placemark>")


def areas_million_homes(t: Tables, pct_min: float = 50.0, box: Sequence[float] = US_BOX) -> DataFrame:
    z = t.zip_census.where(_in_box(box) & (F.col("OwnerOcc") != 0)
                           & (pct("HvalOverMillion", "OwnerOcc") >= pct_min))
    return z.select(*_area_cols())


def areas_with_orders(t: Tables, box: Sequence[float] = US_BOX) -> DataFrame:
    # distinct order ZIPs first (partial aggregation), so a hot ZIP is one row
    zips = t.orders.select(F.col("ZipCode").alias("zcta5")).distinct()
    return t.zip_census.where(_in_box(box)).join(zips, "zcta5", "left_semi").select(*_area_cols())


def foreign_born_split(t: Tables, pct_min: float = 10.0, box: Sequence[float] = US_BOX) -> DataFrame:
    z = t.zip_census.where(_in_box(box) & (F.col("TotPop") != 0))
    share = pct("BornOutsideUS", "TotPop")
    return z.select(F.col("TotPop").alias("tot_pop"), F.col("BornOutsideUS").alias("born_outside_us"),
                    F.col("Longitude").alias("longitude"),
                    F.when(share >= pct_min, F.col("Latitude")).otherwise(F.lit(0.0)).alias("born_outside"),
                    F.when(share < pct_min, F.col("Latitude")).otherwise(F.lit(0.0)).alias("born_inside"))


def top_payment_points(t: Tables, cards: Sequence[tuple[str, str]] = CARD_COLUMNS) -> DataFrame:
    top = mode_by_key(t.orders.select("ZipCode", "PaymentType"), ["ZipCode"], "PaymentType", ties="all")
    top = top.where(F.col("PaymentType").isin(*[c for c, _ in cards]))
    z = t.dimension("zip_census", "zcta5", "Longitude", "Latitude")
    j = top.join(z, top.ZipCode == z.zcta5)
    return j.select(F.col("Longitude").alias("longitude"),
                    *[F.when(F.col("PaymentType") == code, F.col("Latitude")).otherwise(F.lit(0.0)).alias(name)
                      for code, name in cards])


def customers_by_location(t: Tables, box: Sequence[float] = US_BOX) -> DataFrame:
    per_zip = count_distinct(t.orders, ["ZipCode"], "CustomerId", "nb_cust")
    z = t.zip_census.where(_in_box(box)).select("zcta5", "Longitude", "Latitude")
    return (z.join(per_zip, z.zcta5 == per_zip.ZipCode)
            .select(F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"), "nb_cust"))


def work_at_home_share(t: Tables, box: Sequence[float] = US_BOX) -> DataFrame:
    z = t.zip_census.where(_in_box(box) & (F.col("Worker16") != 0) & (F.col("WorkAtHome") != 0))
    return (z.select(F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"),
                     F.round(pct("WorkAtHome", "Worker16"), 2).alias("work_at_home_pct"))
            .orderBy("work_at_home_pct", "longitude", "latitude"))


def _top_zip_per_state(per: DataFrame, value: str) -> DataFrame:
    # one row per (ZIP, state) after aggregation; rn = 1 becomes a per-task group limit
    w = Window.partitionBy("State").orderBy(F.desc(value), "ZipCode")
    return per.withColumn("_seq", F.row_number().over(w)).where(F.col("_seq") == 1).drop("_seq")


def top_sales_zip_by_state(t: Tables, box: Sequence[float] = US_BOX) -> DataFrame:
    o = t.orders.where(F.col("State") != "")
    per = o.groupBy("ZipCode", "State").agg(money_sum("TotalPrice").alias("sum_total_price"))
    best = _top_zip_per_state(per, "sum_total_price")
    z = t.zip_census.where(_in_box(box)).select("zcta5", "Stab", "Longitude", "Latitude")
    return (z.join(best, z.zcta5 == best.ZipCode)
            .select(F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"), "sum_total_price",
                    concat_text(F.col("Stab"), ": ", F.format_number("sum_total_price", 2)).alias("info")))


def top_customer_zip_by_state(t: Tables, box: Sequence[float] = US_BOX) -> DataFrame:
    o = t.orders.where(F.col("State") != "")
    per = count_distinct(o, ["ZipCode", "State"], "CustomerId", "nb_cust")
    best = _top_zip_per_state(per, "nb_cust")
    best = best.join(t.zip_census.select(F.col("Stab").alias("State")).distinct(),
                     "State", "left_semi")
    z = t.zip_census.where(_in_box(box)).select("zcta5", "Longitude", "Latitude")
    return (z.join(best, z.zcta5 == best.ZipCode)
            .orderBy("State", "ZipCode")
            .select(F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"), "nb_cust",
                    concat_text(F.col("State"), ": ", F.col("nb_cust")).alias("info")))


def low_income_placemarks(t: Tables, pct_min: float = 50.0, max_lat: float = 50.0,
                          min_lon: float = -125.0) -> DataFrame:
    share = pct("HHInc0", "TotHHs")
    z = t.zip_census.where((F.col("Latitude") < max_lat) & (F.col("Longitude") > min_lon)
                           & (share > pct_min) & (F.col("TotHHs") != 0))
    shown = F.round(share, 2)
    mark = placemark(F.col("ZIPName"), F.col("zcta5"), concat_text("HHInc0: ", F.format_number(shown, 2)),
                     F.col("Longitude"), F.col("Latitude"))
    return z.select(F.col("Stab").alias("stab"), "zcta5", F.col("ZIPName").alias("zip_name"),
                    F.col("County").alias("county"), F.col("Longitude").alias("longitude"),
                    F.col("Latitude").alias("latitude"), shown.alias("pct_hhinc0"), mark.alias("placemark"))


def top_customer_placemarks(t: Tables, min_rank: float = 0.9, box: Sequence[float] = US_BOX) -> DataFrame:
    per_zip = count_distinct(t.orders, ["ZipCode"], "CustomerId", "nb_cust")
    # the rank is taken over all ZIPs, before the join
    top = ranks(per_zip, [asc("nb_cust")], percent_rank="_pr").where(F.col("_pr") >= min_rank)
    z = t.zip_census.where(_in_box(box)).select("zcta5", "ZIPName", "Longitude", "Latitude")
    j = z.join(top, z.zcta5 == top.ZipCode)
    mark = placemark(F.col("ZIPName"), F.col("zcta5"), concat_text("Number of Customers: ", F.col("nb_cust")),
                     F.col("Longitude"), F.col("Latitude"))
    return j.select(F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"), "nb_cust",
                    mark.alias("placemark"))


def _reference_areas(t: Tables) -> DataFrame:
    """Per state, the area(s) with the most European-born (ties kept).

    RANK = 1 is planned with a partial group limit: every task keeps only its own best areas
    of a state before the shuffle."""
    first = F.rank().over(Window.partitionBy("Stab").orderBy(F.desc("FBEurope")))
    best = t.zip_census.where(F.col("FBEurope").isNotNull() & F.col("Stab").isNotNull()).withColumn("_rank", first).where(F.col("_rank") == 1)
    return best.select(F.col("Stab"), F.col("Stab").alias("ref_stab"), F.col("zcta5").alias("ref_zcta5"), F.col("County").alias("ref_county"),
                       F.col("ZIPName").alias("ref_zip_name"), F.col("Latitude").alias("_rlat"), F.col("Longitude").alias("_rlon"))


def distance_to_state_reference(t: Tables, metric: str = "sphere") -> DataFrame:
    z = t.zip_census.select("Stab", "zcta5", "County", "ZIPName", "Latitude", "Longitude")
    # a few rows per state: copied to salts, so that no task gets a whole state's areas
    j = spread_join(z, _reference_areas(t), ["Stab"], "left")
    d = F.round(distance_miles(metric, F.col("Latitude"), F.col("Longitude"), F.col("_rlat"), F.col("_rlon")), 3)
    if metric == "sphere":
        lat, lon = F.round(rad(F.col("Latitude")), 9), F.round(rad(F.col("Longitude")), 9)
        rlat, rlon = F.round(rad(F.col("_rlat")), 9), F.round(rad(F.col("_rlon")), 9)
        extra = []
    else:
        lat, lon, rlat, rlon = F.col("Latitude"), F.col("Longitude"), F.col("_rlat"), F.col("_rlon")
        extra = [F.col("ref_stab")]
    return (j.select(F.col("Stab").alias("stab"), "zcta5", F.col("County").alias("county"),
                     F.col("ZIPName").alias("zip_name"), lat.alias("latitude"), lon.alias("longitude"),
                     *extra, "ref_zcta5", "ref_county", "ref_zip_name", rlat.alias("ref_latitude"),
                     rlon.alias("ref_longitude"), d.alias("distance"))
            .orderBy("stab", F.asc_nulls_first("distance"), "zcta5", "ref_zcta5"))


def areas_within_of_most_populated(t: Tables, miles: float = 100.0, metric: str = "sphere") -> DataFrame:
    z = t.zip_census.select("state", "zcta5", "ZIPName", "County", "Stab", "Longitude", "Latitude", "TotPop")
    centres = z.where(F.col("TotPop") == z.agg(F.max("TotPop")).scalar()).select("zcta5", "Latitude", "Longitude")
    near = pairs_within(z.drop("TotPop"), centres, miles, metric)
    return (near.select("state", "zcta5", F.col("ZIPName").alias("zip_name"), F.col("County").alias("county"),
                        F.col("Stab").alias("stab"), F.col("Longitude").alias("longitude"),
                        F.col("Latitude").alias("latitude"), F.round("distance", 2).alias("distance"))
            .orderBy("distance", "zcta5"))
