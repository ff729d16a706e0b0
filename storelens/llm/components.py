"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(u, v) for every node u but the smallest v of its component; edges are (u, v) of longs.

    Rounds go on until every node points straight at one that points nowhere; each
    round's edges are a written table, so neither lineage nor the driver grows.  No
    edges give no rows.
    """
    edges, n = stored(_small_star(edges).distinct(), folder, f"{name}_0"), 0
    while True:
        ends = edges.groupBy("u").agg(F.count("*").alias("n"))
        chained = edges.join(ends.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if not ends.filter("n > 1").select("u").unionByName(chained).limit(1).count():
            return edges
        n += 1
        edges = stored(_small_star(_large_star(edges)).distinct(), folder, f"{name}_{n}")
