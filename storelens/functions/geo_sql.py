"""SQL text of the distance expressions in ``functions.geo`` (same operation order)."""

from __future__ import annotations

import math

from storelens.functions.geodesic import Term, Text, geodesic
from storelens.functions.geo import ELLIPSOID_A_FEET, ELLIPSOID_B_FEET, EARTH_RADIUS_MILES, FEET_PER_MILE

PI = f"CAST({math.pi!r} AS DOUBLE)"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def rad(x: str) -> str:
    return f"({x} * {PI} / 180.0)"


def sphere(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p1, p2 = rad(lat1), rad(lat2)
    c = f"sin({p1}) * sin({p2}) + cos({p1}) * cos({p2}) * cos({rad(lon1)} - {rad(lon2)})"
    return f"(acos(greatest(-1.0, least(1.0, {c}))) * {dbl(EARTH_RADIUS_MILES)})"


def ellipsoid(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    feet = geodesic(Term(lat1), Term(lon1), Term(lat2), Term(lon2), ELLIPSOID_A_FEET, ELLIPSOID_B_FEET, on=Text)
    return f"({feet} / {dbl(FEET_PER_MILE)})"
