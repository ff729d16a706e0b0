"""Distance expressions for the DuckDB texts, from the published formulas and literal constants."""

from __future__ import annotations

PI = "CAST(3.141592653589793 AS DOUBLE)"
# fixed values: mean earth radius in miles; Clarke 1880 (international foot) half axes in feet
RADIUS = "CAST(3957.773 AS DOUBLE)"
MAJOR, MINOR, FEET = 20926202.0, 20854895.0, 5280.0


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def rad(x: str) -> str:
    return f"({x} * {PI} / 180.0)"


def sphere(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Spherical law of cosines."""
    p1, p2 = rad(lat1), rad(lat2)
    angle = f"sin({p1}) * sin({p2}) + cos({p1}) * cos({p2}) * cos({rad(lon1)} - {rad(lon2)})"
    return f"(acos(greatest(-1.0, least(1.0, {angle}))) * {RADIUS})"


def _with(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def ellipsoid(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The inverse solution of Vincenty: the longitude on the auxiliary sphere by twelve substitutions."""
    flat, excess = (MAJOR - MINOR) / MAJOR, MAJOR ** 2 / MINOR ** 2 - 1
    u1, u2 = (f"atan({dbl(1 - flat)} * tan({rad(x)}))" for x in (lat1, lat2))
    ends = f"{{'s': sin({u1}) * sin({u2}), 'c': cos({u1}) * cos({u2}), 'p': cos({u1}) * sin({u2}), 'q': sin({u1}) * cos({u2}), 'o': cos({u2}), 'l': {rad(lon2)} - {rad(lon1)}}}"
    arc = "{'y': sqrt(pow(e.o * sin(x), 2) + pow(e.p - e.q * cos(x), 2)), 'x': e.s + e.c * cos(x)}"
    # sine of the azimuth at the equator, its square's complement, twice the middle's cosine
    slope = "if(a.y = 0, 0.0, e.c * sin(x) / a.y)"
    line = "{'g': atan2(a.y, a.x), 'k': k, 'n': 1 - k * k, 'm': if(1 - k * k <= 1e-15, 0.0, a.x - 2 * e.s / (1 - k * k))}"

    def on_line(body: str) -> str:
        return _with("a", arc, _with("k", slope, _with("v", line, body)))

    third = f"{dbl(flat / 16)} * v.n * (4 + {dbl(flat)} * (4 - 3 * v.n))"
    along = "(v.g + t * a.y * (v.m + t * a.x * (2 * v.m * v.m - 1)))"
    following = on_line(_with("t", third, f"e.l + (1 - t) * {dbl(flat)} * v.k * {along}"))
    less = "(v.m + z.b / 4 * (a.x * (2 * v.m * v.m - 1) - z.b / 6 * v.m * (4 * a.y * a.y - 3) * (4 * v.m * v.m - 3)))"
    ratio = f"(sqrt(1 + {dbl(excess)} * v.n) - 1) / (sqrt(1 + {dbl(excess)} * v.n) + 1)"
    miles = on_line(_with("r", ratio, _with("z", "{'a': (1 + r * r / 4) / (1 - r), 'b': r * (1 - 0.375 * r * r)}",
                                            f"{dbl(MINOR / FEET)} * z.a * (v.g - z.b * a.y * {less})")))
    settled = f"list_reduce([e.l, {', '.join(['e.l'] * 12)}], lambda x, again: {following})"
    return _with("e", ends, _with("x", settled, miles))
