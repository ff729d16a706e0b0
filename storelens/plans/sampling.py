"""Sampling and average-value models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.semantics import as_long, in_years, is_weekend, money_avg, safe_ratio, seeded_key
from storelens.operators import sampling
from storelens.operators.ranking import asc, desc, ntile
from storelens.sources.tables import Tables

DEFAULT_SEED = "42"


def _product_cols():
    return [F.col("ProductId").alias("product_id"), F.col("GroupName").alias("group_name"),
            F.col("IsInStock").alias("is_in_stock"), F.col("FullPrice").alias("full_price")]


def sample_top_percent(t: Tables, pct: float = 10.0, seed: str = DEFAULT_SEED) -> DataFrame:
    c = t.campaigns.select(seeded_key(seed, "CampaignId").alias("guid"), F.col("CampaignId").alias("campaign_id"),
                           F.col("Channel").alias("channel"), F.col("Discount").alias("discount"))
    return sampling.top_percent(c, pct, [asc("guid"), asc("campaign_id")]).orderBy("guid", "campaign_id")


def sample_hash_percent(t: Tables, pct: float = 10.0, seed: str = DEFAULT_SEED) -> DataFrame:
    return sampling.hash_sample(t.subscribers, "SubscriberId", pct, seed)


def sample_repeated(t: Tables, mult: int = 79, add: int = 19, pct: int = 10) -> DataFrame:
    rn = F.col("row_number")
    out = sampling.every_kth(t.products.select(*_product_cols()), [asc("product_id")],
                             (rn * mult + add) % 100 < pct)
    return out.select(as_long("row_number").alias("row_number"), "product_id", "group_name", "is_in_stock",
                      "full_price")


def group_share(t: Tables) -> DataFrame:
    g = t.products.groupBy(F.col("GroupName").alias("group_name")).agg(F.count(F.lit(1)).alias("group_total"))
    # one row per group (bounded): the unpartitioned window only sees those rows
    g = g.withColumn("total", F.sum("group_total").over(Window.partitionBy()))
    return g.withColumn("share", F.round(safe_ratio("group_total", "total"), 2)).orderBy("share", "group_name")


def sample_stratified(t: Tables, step: int = 100, offset: int = 3) -> DataFrame:
    out = sampling.every_kth(t.products.select(*_product_cols()), [asc("group_name"), asc("product_id")],
                             F.col("row_number") % step == offset)
    return (out.select(as_long("row_number").alias("row_number"), "product_id", "group_name", "is_in_stock",
                       "full_price").orderBy("group_name", "row_number"))


def _big_orders(t: Tables, year: int, min_price: float) -> DataFrame:
    return t.on_calendar(t.orders.where(in_years("OrderDate", [year]) & (F.col("TotalPrice") > min_price)), "OrderDate")


def _weekend_split(df: DataFrame) -> DataFrame:
    wk = is_weekend("OrderDate")
    return df.select(F.col("OrderId").alias("order_id"), F.col("OrderDate").alias("order_date"),
                     F.col("TotalPrice").alias("total_price"),
                     F.when(wk, F.col("TotalPrice")).alias("weekend"),
                     F.when(~wk, F.col("TotalPrice")).alias("not_weekend"))


def big_orders_weekend_split(t: Tables, year: int = 2015, min_price: float = 1000.0) -> DataFrame:
    return _weekend_split(_big_orders(t, year, min_price)).orderBy(F.desc("total_price"), "order_id")


def sample_balanced(t: Tables, k: int = 50, year: int = 2015, min_price: float = 1000.0,
                    seed: str = DEFAULT_SEED) -> DataFrame:
    o = _big_orders(t, year, min_price).withColumn("_wk", is_weekend("OrderDate"))
    return _weekend_split(sampling.balanced_sample(o, "_wk", k, seed, "OrderId"))


# --- average-value models -------------------------------------------------

def _gender_orders(t: Tables, gender: str) -> DataFrame:
    c = t.customers.where(F.col("Gender") == gender).select("CustomerId")
    return t.orders.join(c, "CustomerId")


def avg_price_by_year(t: Tables, gender: str = "F", years: Sequence[int] = (2014, 2015)) -> DataFrame:
    o = _gender_orders(t, gender).where(in_years("OrderDate", years))
    return o.groupBy(as_long(F.year("OrderDate")).alias("year")).agg(
        money_avg("TotalPrice").alias("average_total_price"))


def avg_price_all_years(t: Tables, gender: str = "F") -> DataFrame:
    return (_gender_orders(t, gender).groupBy(as_long(F.year("OrderDate")).alias("year"))
            .agg(money_avg("TotalPrice").alias("average_total_price")).orderBy("year"))


def _cells(t: Tables, dims: Sequence[str], model_year: int, score_year: int, gender: str) -> DataFrame:
    """One row per dimension cell from one pass over the gender's orders: sum, count and average
    of the model year (``_ms``, ``_mn``, ``_cell``), the same of the score year and its rows
    (``_ss``, ``_sn``, ``_rows``), and whether the rows are scored (``_in``).

    When a dimension is the channel, an order without a campaign is neither scored nor part of a
    cell (inner join, as in the reference), but it counts in the overall average."""
    data = _gender_orders(t, gender).where(in_years("OrderDate", [model_year, score_year]))
    seen = F.lit(True)
    if "Channel" in dims:
        data = data.join(t.dimension("campaigns", "CampaignId", "Channel").withColumn("_seen", F.lit(True)), "CampaignId", "left")
        seen = F.coalesce("_seen", F.lit(False))
    price, model = F.col("TotalPrice"), in_years("OrderDate", [model_year])
    cells = data.groupBy(*dims, seen.alias("_in")).agg(
        F.sum(F.when(model, price)).alias("_ms"), F.count(F.when(model, price)).alias("_mn"),
        F.sum(F.when(~model, price)).alias("_ss"), F.count(F.when(~model, price)).alias("_sn"),
        F.count(F.when(~model, 1)).alias("_rows"))
    return cells.select("*", F.when(F.col("_mn") > 0, F.col("_ms").cast("double") / F.col("_mn")).alias("_cell"))


def _overall():
    """The model-year average over all orders, from their cells."""
    return F.sum("_ms").cast("double") / F.nullif(F.sum("_mn"), F.lit(0))


def scored_orders(t: Tables, dims: Sequence[str], model_year: int = 2014, score_year: int = 2015,
                  gender: str = "F") -> DataFrame:
    """Score-year orders with the model-year average of their dimension cell
    (``model``), falling back to the overall model-year average."""
    cells = _cells(t, dims, model_year, score_year, gender)
    fallback = cells.agg(_overall()).scalar()
    score = _gender_orders(t, gender).where(in_years("OrderDate", [score_year]))
    if "Channel" in dims:
        score = score.join(t.dimension("campaigns", "CampaignId", "Channel"), "CampaignId")
    known = cells.where(F.col("_in") & F.col("_cell").isNotNull()).select(*dims, "_cell")
    return score.join(known, list(dims), "left").select("OrderId", F.col("TotalPrice").alias("score"),
                                                        F.coalesce(F.col("_cell"), fallback).alias("model"))


def value_model(t: Tables, dims: Sequence[str] = ("State",), model_year: int = 2014, score_year: int = 2015,
                gender: str = "F") -> DataFrame:
    """Averages of the actual and the predicted score-year price, from one row per
    dimension cell: orders are read once.  Score rows of cells without a model-year
    price, or with a NULL dimension, are predicted by the overall average."""
    cells = _cells(t, dims, model_year, score_year, gender)
    known = F.col("_cell").isNotNull()
    for d in dims:
        known = known & F.col(d).isNotNull()
    own = F.when(F.col("_in") & known, F.col("_cell") * F.col("_rows"))
    rest = F.when(F.col("_in") & ~known, F.col("_rows"))
    total = cells.agg(_overall().alias("_all"), F.sum(F.when(F.col("_in"), F.col("_ss"))).alias("_s"),
                      F.sum(F.when(F.col("_in"), F.col("_sn"))).alias("_n"), F.sum(own).alias("_own"),
                      F.sum(F.when(own.isNotNull(), F.col("_rows"))).alias("_on"), F.sum(rest).alias("_rest"))
    rest_n = F.when(F.col("_all").isNotNull(), F.coalesce("_rest", F.lit(0))).otherwise(F.lit(0))
    rows = F.coalesce("_on", F.lit(0)) + rest_n
    return total.select(F.round(F.col("_s").cast("double") / F.nullif(F.col("_n"), F.lit(0)), 6).alias("avg_score"),
                        F.round((F.coalesce("_own", F.lit(0.0)) + rest_n * F.coalesce("_all", F.lit(0.0))) / F.nullif(rows, F.lit(0)), 6)
                        .alias("avg_model"))


def value_chart(t: Tables, dims: Sequence[str] = ("Channel", "PaymentType"), buckets: int = 10,
                model_year: int = 2014, score_year: int = 2015, gender: str = "F") -> DataFrame:
    s = scored_orders(t, dims, model_year, score_year, gender)
    tiled = ntile(s, buckets, [desc("model"), asc("OrderId")], name="decile")
    return (tiled.groupBy(as_long("decile").alias("decile"))
            .agg(F.round(F.avg("model"), 6).alias("avg_model"), money_avg("score").alias("avg_score"))
            .orderBy("decile"))
