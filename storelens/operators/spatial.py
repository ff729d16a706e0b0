"""Distance join: all (point, centre) pairs closer than a radius.

Instead of a cross join, points get one grid cell each and every centre lists
the cells its radius can reach; the pairs come from an equi join on the cell,
then the exact distance is applied.  Cells are ``radius`` high in latitude
(one degree of latitude is at least 68.7 miles on both models) and the same
number of degrees wide, so a centre touches 3 cells in latitude and a few in
longitude (more only near the poles, where the longitude span widens; it is
capped at the full circle and wraps at the antimeridian).

A cell that holds more than ``dense`` points is the root of a quadtree: exact counts of its
smallest cells, summed upwards, say which quadrants are still dense and are split again, up
to ``DEPTH`` times; a smallest cell that is still dense (one town, one point) is cut by salts.
A point finds its leaf by binary search among the leaves' first places along the Z-order curve,
one sorted array of few entries per ``dense`` points, a scalar subquery; a centre meets the
leaves whose points' bounding boxes its radius can reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.geo import distance_miles

_MILES_PER_DEG_LAT_MIN = 68.0  # below the true minimum (about 68.7)
_MILES_PER_DEG_LON_EQ = 69.0   # below the true maximum (about 69.2)
#: How often a dense cell is split, and how many points make one dense.
DEPTH, DENSE = 6, 1_000_000


def grid(miles: float) -> tuple[float, int]:
    h = miles / _MILES_PER_DEG_LAT_MIN
    nlon = max(1, int(math.floor(360.0 / h)))
    return h, nlon


def point_place(lat: Column, lon: Column, miles: float) -> Column:
    """Place of a point: its grid cell, then its smallest cell inside it along the Z-order curve."""
    h, nlon = grid(miles)
    w = 360.0 / nlon
    y = F.floor((lat + 90.0) / h * (1 << DEPTH)).cast("bigint")
    x = F.pmod(F.floor((lon + 180.0) / w * (1 << DEPTH)).cast("bigint"), F.lit(nlon << DEPTH))
    place = F.shiftright(y, DEPTH) * nlon + F.shiftright(x, DEPTH)
    for bit in range(DEPTH - 1, -1, -1):
        for c in (y, x):
            place = place * 2 + F.shiftright(c, bit).bitwiseAND(F.lit(1))
    return place


def _leaves(places: DataFrame, dense: int) -> DataFrame:
    """The quadtree leaves of dense grid cells, from points (_place, _lat, _lon): their root, depth, node and first
    place, how many salts they need, and the box around their points."""
    box = [F.min("s").alias("s"), F.max("n").alias("n"), F.min("w").alias("w"), F.max("e").alias("e")]
    cells = places.where(F.col("_place").isNotNull()).groupBy("_place").agg(
        F.count(F.lit(1)).alias("points"), F.min("_lat").alias("s"), F.max("_lat").alias("n"), F.min("_lon").alias("w"), F.max("_lon").alias("e"))
    above = [F.struct(F.lit(d).alias("depth"), F.shiftright("_place", 2 * (DEPTH - d)).alias("node")) for d in range(DEPTH + 1)]
    nodes = cells.select("*", F.inline(F.array(*above))).groupBy("depth", "node").agg(F.sum("points").alias("points"), *box)
    parents = nodes.where((F.col("points") > dense) & (F.col("depth") < DEPTH)).select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    leaves = (nodes.where((F.col("points") <= dense) | (F.col("depth") == DEPTH)).withColumn("parent", F.shiftright("node", 2))
              .join(parents, ["depth", "parent"], "left_semi"))
    up = F.col("node") * F.pow(F.lit(4), DEPTH - F.col("depth")).cast("bigint")
    return leaves.select("depth", "node", up.alias("first"), F.shiftright(up, 2 * DEPTH).alias("root"),
                         F.ceil(F.col("points") / dense).cast("int").alias("salts"), "s", "n", "w", "e")


def _with_leaf(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """``points`` (_place) with _depth, _node and _salt: the leaf that holds a point, or its grid cell."""
    held = leaves.agg(F.sort_array(F.collect_list(F.struct("first", "depth", "salts")))).scalar()
    widths = F.sequence(F.ceil(F.log2(F.size("_held") + 1)).cast("int"), F.lit(0), F.lit(-1))

    def step(state: Column, exponent: Column) -> Column:
        to = state["p"] + F.pow(F.lit(2), exponent).cast("int")
        go = (to <= F.size(state["a"])) & (F.get(state["a"], to - 1)["first"] <= F.col("_place"))
        return F.struct(F.when(go, to).otherwise(state["p"]).alias("p"), state["a"].alias("a"))

    found = F.aggregate(widths, F.struct(F.lit(0).alias("p"), F.col("_held").alias("a")), step, lambda state: F.get(state["a"], state["p"] - 1))
    rows = points.withColumn("_held", held).withColumn("_leaf", found).drop("_held")
    size = F.pow(F.lit(4), DEPTH - F.col("_leaf.depth")).cast("bigint")
    inside = F.col("_place") < F.col("_leaf.first") + size
    own = [F.col(f"`{c}`") for c in points.columns]
    salt = F.pmod(F.xxhash64(*own), F.col("_leaf.salts")).cast("int")
    return rows.select(*own, F.when(inside, F.col("_leaf.depth")).otherwise(0).alias("_depth"),
                       F.when(inside, F.col("_leaf.first")).otherwise(F.shiftright("_place", 2 * DEPTH)).alias("_node"),
                       F.when(inside, salt).otherwise(0).alias("_salt"))


def lon_span(lat: Column, miles: float) -> Column:
    """Degrees of longitude that a centre's radius can reach."""
    lat_hi = F.least(F.lit(90.0), F.abs(lat) + miles / _MILES_PER_DEG_LAT_MIN)
    cosmin = F.cos(F.radians(lat_hi))
    return F.when(cosmin <= 1e-9, F.lit(180.0)).otherwise(
        F.least(F.lit(180.0), F.lit(miles / _MILES_PER_DEG_LON_EQ) / cosmin))


def centre_cells(lat: Column, lon: Column, miles: float) -> Column:
    """Array of (lat cell, lon cell) structs a centre's radius can reach."""
    h, nlon = grid(miles)
    w = 360.0 / nlon
    dlat = miles / _MILES_PER_DEG_LAT_MIN
    span = lon_span(lat, miles)
    lat_cells = F.sequence(F.floor((lat - dlat + 90.0) / h).cast("bigint"),
                           F.floor((lat + dlat + 90.0) / h).cast("bigint"))
    lo = F.floor((lon - span + 180.0) / w).cast("bigint")
    hi = F.floor((lon + span + 180.0) / w).cast("bigint")
    hi = F.least(hi, lo + nlon - 1)
    lon_cells = F.array_distinct(F.transform(F.sequence(lo, hi), lambda c: F.pmod(c, F.lit(nlon))))
    return F.flatten(F.transform(lat_cells, lambda a: F.transform(
        lon_cells, lambda b: F.struct(a.alias("clat"), b.alias("clon")))))


def keyed(points: DataFrame, centres: DataFrame, miles: float, lat: str = "Latitude", lon: str = "Longitude", prefix: str = "c_",
          dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Both sides of the distance join with the key (_depth, _node, _salt): a point has one, a centre all it can reach."""
    h, nlon = grid(miles)
    p = points.withColumn("_place", point_place(F.col(lat), F.col(lon), miles))
    leaves = _leaves(p.select("_place", F.col(lat).alias("_lat"), F.col(lon).alias("_lon")), dense)
    c = centres.select(*[F.col(x).alias(prefix + x) for x in centres.columns])
    own = [F.col(f"`{x}`") for x in c.columns]
    clat, clon = F.col(prefix + lat), F.col(prefix + lon)
    c = c.select(*own, F.explode(centre_cells(clat, clon, miles)).alias("_cell"))
    c = c.select(*own, (F.col("_cell.clat") * nlon + F.col("_cell.clon")).alias("_root"))
    boxes = leaves.select(F.col("root").alias("_root"), F.struct("depth", "first", "salts", "s", "n", "w", "e").alias("_leaf"))
    c = c.join(boxes, "_root", "left")
    # reached: the box lies within the band of latitudes, and round the globe within the span of longitudes
    dlat, span, width = h + 1e-9, lon_span(clat, miles) + 1e-9, F.col("_leaf.e") - F.col("_leaf.w")
    beside = F.least(F.pmod(F.col("_leaf.w") - clon, F.lit(360.0)), F.pmod(clon - F.col("_leaf.e"), F.lit(360.0))) <= span
    across = (F.pmod(clon - F.col("_leaf.w"), F.lit(360.0)) <= width) | beside
    reached = (F.col("_leaf.n") >= clat - dlat) & (F.col("_leaf.s") <= clat + dlat) & across
    c = c.where(F.col("_leaf").isNull() | reached)
    c = c.select(*own, F.coalesce("_leaf.depth", F.lit(0)).alias("_depth"), F.coalesce("_leaf.first", "_root").alias("_node"),
                 F.explode(F.sequence(F.lit(0), F.coalesce("_leaf.salts", F.lit(1)) - 1)).alias("_salt"))
    return _with_leaf(p, leaves).drop("_place"), c


def pairs_within(points: DataFrame, centres: DataFrame, miles: float, metric: str = "sphere",
                 lat: str = "Latitude", lon: str = "Longitude", prefix: str = "c_", dense: int = DENSE) -> DataFrame:
    """Rows of ``points`` joined with every row of ``centres`` (columns renamed
    with ``prefix``) whose distance is below ``miles``; adds ``distance``."""
    if miles <= 0:  # no distance is below it
        points, miles = points.where(F.lit(False)), 1.0
    p, c = keyed(points, centres, miles, lat, lon, prefix, dense)
    d = distance_miles(metric, F.col(lat), F.col(lon), F.col(prefix + lat), F.col(prefix + lon))
    key = ["_depth", "_node", "_salt"]
    return p.join(c, key).withColumn("distance", d).where(F.col("distance") < miles).drop(*key)


def within_of_point(points: DataFrame, lat0: float, lon0: float, miles: float, metric: str = "ellipsoid",
                    lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Rows of ``points`` closer than ``miles`` to one fixed point: a latitude
    band prefilter (cheap comparison) before the exact distance."""
    dlat = miles / _MILES_PER_DEG_LAT_MIN
    d = distance_miles(metric, F.col(lat), F.col(lon), F.lit(float(lat0)), F.lit(float(lon0)))
    return (points.where(F.col(lat).between(lat0 - dlat, lat0 + dlat))
            .withColumn("distance", d).where(F.col("distance") < miles))
