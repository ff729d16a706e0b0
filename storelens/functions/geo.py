"""Distances on the sphere and on an ellipsoid, as column expressions (degrees in).

The ellipsoid distance is the geodesic's length (``functions.geodesic``).  The default
ellipsoid is the one of SRID 4748 used by the reference, in feet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens.functions.geodesic import geodesic

# Fixed values of the reference: earth radius in miles for the angle method,
# feet per mile for the geography method.
EARTH_RADIUS_MILES = 3957.773
FEET_PER_MILE = 5280.0
# Ellipsoid of SRID 4748 (Clarke 1880, international foot), published EPSG values.
ELLIPSOID_A_FEET = 20926202.0
ELLIPSOID_B_FEET = 20854895.0


def rad(deg: Column) -> Column:
    """``deg * PI() / 180`` (same operation order as the reference)."""
    return deg * F.lit(math.pi) / F.lit(180.0)


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                       radius: float = EARTH_RADIUS_MILES) -> Column:
    """Spherical law of cosines; the cosine is clamped to [-1, 1] so a point
    against itself gives 0 instead of NaN.  NULL coordinates give NULL."""
    p1, p2 = rad(lat1), rad(lat2)
    c = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(rad(lon1) - rad(lon2))
    return F.when(c.isNotNull(), F.acos(_clamp(c)) * F.lit(radius))  # LEAST and GREATEST pass over NULLs


def ellipsoid_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                    a: float = ELLIPSOID_A_FEET, b: float = ELLIPSOID_B_FEET,
                    unit_per_mile: float = FEET_PER_MILE) -> Column:
    return geodesic(lat1, lon1, lat2, lon2, a, b) / F.lit(unit_per_mile)


def distance_miles(metric: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    if metric == "sphere":
        return great_circle_miles(lat1, lon1, lat2, lon2)
    if metric == "ellipsoid":
        return ellipsoid_miles(lat1, lon1, lat2, lon2)
    raise ValueError(f"unknown metric {metric!r}")
