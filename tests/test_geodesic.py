"""Published geodesic lengths, to a millimetre."""

import pytest
from pyspark.sql import functions as F

from storelens.functions.geodesic import Term, Text, geodesic

WGS84 = (6378137.0, 6378137.0 * (1 - 1 / 298.257223563))
GRS80 = (6378137.0, 6378137.0 * (1 - 1 / 298.257222101))


def dms(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (1 if d > 0 else -1)


LINES = [
    # a trigonometric survey's example line, and the example of a geodesic calculator's manual
    (GRS80, dms(-37, 57, 3.7203), dms(144, 25, 29.5244), dms(-37, 39, 10.1561), dms(143, 55, 35.3839), 54972.271),
    (WGS84, 40.6, -73.8, 51.6, -0.5, 5551759.400),
    # nearly antipodal: the example of Karney (2013), and a line on which the fixed point does not settle
    (WGS84, -30.0, 0.0, 29.9, 179.8, 19989832.827610),
    (WGS84, 0.0, 0.0, 0.5, 179.5, 19936288.578965),
    # a quarter of the equator, from pole to pole, exactly opposite points (both over a pole), the antimeridian
    (WGS84, 0.0, 0.0, 0.0, 90.0, 10018754.171395),
    (WGS84, 90.0, 10.0, -90.0, 50.0, 20003931.458625),
    (WGS84, 0.0, -60.0, 0.0, 120.0, 20003931.458625),
    (WGS84, 45.0, 0.0, -45.0, 180.0, 20003931.458625),
    (WGS84, 0.0, 179.5, 0.0, -179.5, 111319.490793),
    (WGS84, 12.0, 34.0, 12.0, 34.0, 0.0),
]


@pytest.mark.parametrize("axes, lat1, lon1, lat2, lon2, want", LINES)
def test_published_lines(spark, axes, lat1, lon1, lat2, lon2, want):
    df = spark.createDataFrame([(lat1, lon1, lat2, lon2), (lat2, lon2, lat1, lon1), (-lat1, -lon1, -lat2, -lon2)], "a double, b double, c double, d double")
    text = geodesic(*map(Term, "abcd"), *axes, on=Text)
    for r in df.select(geodesic(*[F.col(x) for x in "abcd"], *axes).alias("m"), F.expr(str(text)).alias("t")).collect():
        assert abs(r.m - want) < 1e-3 and r.t == r.m


def test_nulls(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, 3.0), (1.0, 2.0, 3.0, None)], "a double, b double, c double, d double")
    assert {r[0] for r in df.select(geodesic(*[F.col(x) for x in "abcd"], *WGS84)).collect()} == {None}
