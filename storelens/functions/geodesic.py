"""Geodesic length on an ellipsoid by iteration, said once for columns and for SQL text.

``Columns`` and ``Text`` offer the same few operations; ``geodesic`` is written with them.

Points that are not nearly antipodal: the inverse solution of Vincenty (1975), whose longitude on
the auxiliary sphere is a fixed point; six rounds leave less than 1e-11 radians.  Where they do not (nearly
antipodal points), the azimuth of the geodesic at the point farther from the equator is bisected: with
that point on the southern side, the longitude difference that an azimuth leads to at the other point's
latitude grows with the azimuth from 0 to pi, so 52 halvings find it.  Points that lie
exactly opposite each other have a defined answer as well: the shortest way, over the nearer pole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, HALVINGS, CONVERGED = 6, 52, 1e-11


class Columns:
    """Operations on Spark columns."""

    sin, cos, tan, atan, atan2, sqrt, abs, least, greatest, floor = (
        staticmethod(f) for f in (F.sin, F.cos, F.tan, F.atan, F.atan2, F.sqrt, F.abs, F.least, F.greatest, F.floor))
    num = staticmethod(F.lit)

    @staticmethod
    def known(x: Column, then: Column) -> Column:
        return F.when(x.isNotNull(), then)

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def pair(a: Column, b: Column) -> Column:
        return F.array(a, b)

    @staticmethod
    def when(test: Column, then: Column, other: Column) -> Column:
        return F.when(test, then).otherwise(other)

    @staticmethod
    def let(value: Column, body: Callable) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    @staticmethod
    def loop(times: int, start: Column, body: Callable) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda state, _: body(state))


class Term(str):
    """SQL text with arithmetic."""

    def _with(self, op: str, other) -> Term:
        return Term(f"({self} {op} {other if isinstance(other, Term) else Text.num(other)})")

    def __add__(self, other): return self._with("+", other)
    def __sub__(self, other): return self._with("-", other)
    def __mul__(self, other): return self._with("*", other)
    def __truediv__(self, other): return self._with("/", other)
    def __radd__(self, other): return Text.num(other) + self
    def __rsub__(self, other): return Text.num(other) - self
    def __rmul__(self, other): return Text.num(other) * self
    def __rtruediv__(self, other): return Text.num(other) / self
    def __lt__(self, other): return self._with("<", other)
    def __le__(self, other): return self._with("<=", other)
    def __eq__(self, other): return self._with("=", other)
    def __getitem__(self, i): return Term(f"{str(self)}[{i}]")
    __hash__ = str.__hash__


class Text:
    """The same operations as Spark SQL text."""

    names = 0

    @staticmethod
    def known(x: Term, then: Term) -> Term:
        return Term(f"CASE WHEN {x} IS NOT NULL THEN {then} END")

    @staticmethod
    def num(value) -> Term:
        return Term(f"CAST({float(value)!r} AS DOUBLE)")

    @staticmethod
    def both(a: Term, b: Term) -> Term:
        return Term(f"({a} AND {b})")

    @staticmethod
    def pair(a: Term, b: Term) -> Term:
        return Term(f"array({a}, {b})")

    @staticmethod
    def when(test: Term, then, other) -> Term:
        then, other = (x if isinstance(x, Term) else Text.num(x) for x in (then, other))
        return Term(f"CASE WHEN {test} THEN {then} ELSE {other} END")

    @classmethod
    def _name(cls) -> Term:
        cls.names += 1
        return Term(f"v{cls.names}")

    @classmethod
    def let(cls, value: Term, body: Callable) -> Term:
        v = cls._name()
        return Term(f"transform(array({value}), {v} -> {body(v)})[0]")

    @classmethod
    def loop(cls, times: int, start: Term, body: Callable) -> Term:
        v = cls._name()
        return Term(f"aggregate(sequence(1, {times}), {start}, ({v}, {v}_) -> {body(v)})")


for _f in ("sin", "cos", "tan", "atan", "atan2", "sqrt", "abs", "least", "greatest", "floor"):
    setattr(Text, _f, staticmethod(lambda *x, f=_f: Term(f"{f}({', '.join(t if isinstance(t, Term) else Text.num(t) for t in x)})")))


def geodesic(lat1, lon1, lat2, lon2, a: float, b: float, on=Columns):
    """Length, in the unit of the half axes ``a`` >= ``b``, of the shortest line between two points (degrees); null if one is."""
    f, deg = (a - b) / a, math.pi / 180
    second = (a * a - b * b) / (b * b)

    def square(x):
        return x * x

    def turn(cos2_alpha):
        """The coefficient C of the longitude series."""
        return f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))

    def bend(c, sigma, sin_s, cos_s, cos_2m):
        return sigma + c * sin_s * (cos_2m + c * cos_s * (2 * square(cos_2m) - 1))

    def length(cos2_alpha, sigma, sin_s, cos_s, cos_2m):
        def from_k(k):
            big = (1 + square(k) / 4) / (1 - k)
            small = k * (1 - 3 / 8 * square(k))
            less = small / 6 * cos_2m * (4 * square(sin_s) - 3) * (4 * square(cos_2m) - 3)
            return b * big * (sigma - small * sin_s * (cos_2m + small / 4 * (cos_s * (2 * square(cos_2m) - 1) - less)))

        root = on.sqrt(1 + second * cos2_alpha)
        return on.let((root - 1) / (root + 1), from_k)

    def lets(values, body, *got):
        """``body`` of the values, each made from those before it."""
        if not values:
            return body(*got)
        return on.let(values[0](*got), lambda v: lets(values[1:], body, *got, v))

    def between(su1, cu1, su2, cu2, lon):
        def step(lam, then):
            return lets([
                lambda: on.sqrt(square(cu2 * on.sin(lam)) + square(cu1 * su2 - su1 * cu2 * on.cos(lam))),
                lambda sin_s: su1 * su2 + cu1 * cu2 * on.cos(lam),
                lambda sin_s, cos_s: on.when(sin_s == 0.0, on.num(0.0), cu1 * cu2 * on.sin(lam) / sin_s),
                lambda sin_s, cos_s, sin_a: 1 - square(sin_a),
                lambda sin_s, cos_s, sin_a, cos2: on.when(cos2 <= 1e-15, on.num(0.0), cos_s - 2 * su1 * su2 / cos2),
            ], lambda sin_s, cos_s, sin_a, cos2, cos_2m: then(sin_s, cos_s, on.atan2(sin_s, cos_s), sin_a, cos2, cos_2m))

        def next_of(lam):
            return step(lam, lambda sin_s, cos_s, sigma, sin_a, cos2, cos_2m: lon + (1 - turn(cos2)) * f * sin_a * bend(turn(cos2), sigma, sin_s, cos_s, cos_2m))

        def far(lam):
            return step(lam, lambda sin_s, cos_s, sigma, sin_a, cos2, cos_2m: length(cos2, sigma, sin_s, cos_s, cos_2m))

        return on.let(on.loop(ROUNDS, lon, next_of), lambda lam: on.when(
            on.both(on.abs(next_of(lam) - lam) < CONVERGED, on.abs(lam) <= math.pi), far(lam), opposite(su1, su2, lon)))

    def opposite(su1, su2, lon):
        """The point farther from the equator first, and south of it."""
        swap = on.abs(su1) < on.abs(su2)
        first, other = on.when(swap, su2, su1), on.when(swap, su1, su2)

        def solve(s1, s2):
            c1, c2 = on.sqrt(1 - square(s1)), on.sqrt(1 - square(s2))

            def step(azimuth, then):
                return lets([
                    lambda: on.sin(azimuth) * c1,
                    lambda sin_a: on.cos(azimuth),
                    lambda sin_a, cos_z: on.sqrt(on.greatest(on.num(0.0), square(cos_z * c1) + (square(c2) - square(c1)))),
                    lambda sin_a, cos_z, cos_z2: on.atan2(s1, cos_z * c1),
                    lambda sin_a, cos_z, cos_z2, s_1: on.atan2(s2, cos_z2),
                ], lambda sin_a, cos_z, cos_z2, s_1, s_2: then(sin_a, cos_z, cos_z2, s_2 - s_1, s_1 + s_2))

            def reached(azimuth):
                def lon_of(sin_a, cos_z, cos_z2, sigma, double_mid):
                    c = turn(1 - square(sin_a))
                    way = on.atan2(sin_a * s2, cos_z2) - on.atan2(sin_a * s1, cos_z * c1)
                    return way - (1 - c) * f * sin_a * bend(c, sigma, on.sin(sigma), on.cos(sigma), on.cos(double_mid))
                return step(azimuth, lon_of)

            def halve(state):
                """(lower end, width): the middle is the new lower end if its line does not lead far enough."""
                return on.let(state[1] / 2, lambda half: on.pair(on.when(reached(state[0] + half) < lon, state[0] + half, state[0]), half))

            found = on.loop(HALVINGS, on.pair(on.num(0.0), on.num(math.pi)), halve)[0]
            return on.let(found, lambda z: step(z, lambda sin_a, cos_z, cos_z2, sigma, double_mid: length(
                1 - square(sin_a), sigma, on.sin(sigma), on.cos(sigma), on.cos(double_mid))))

        south = on.when(first <= 0.0, first, 0.0 - first)
        mirrored = on.when(first <= 0.0, other, 0.0 - other)
        return on.let(on.least(south, on.num(-1e-15)), lambda s1: on.let(mirrored, lambda s2: solve(s1, s2)))

    def sine(lat):
        return on.sin(on.atan((1 - f) * on.tan(lat * deg)))

    def cosine(lat):
        return on.cos(on.atan((1 - f) * on.tan(lat * deg)))

    turned = on.let(lon2 - lon1, lambda d: on.abs(d - 360.0 * on.floor((d + 180.0) / 360.0)) * deg)
    line = lets([lambda: sine(lat1), lambda s1: cosine(lat1), lambda s1, c1: sine(lat2), lambda s1, c1, s2: cosine(lat2), lambda s1, c1, s2, c2: turned], between)
    return on.known(lat1 + lon1 + lat2 + lon2, line)
