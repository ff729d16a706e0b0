"""Column expressions for the reference's scalar semantics.

All of these are built-in Catalyst expressions (no Python UDFs), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(38,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """``a*1.0/b`` as a double; NULL instead of a division-by-zero error."""
    return col(a).cast("double") / F.nullif(col(b), F.lit(0)).cast("double")


def pct(a: str | Column, b: str | Column) -> Column:
    """``a*1.0/b*100``."""
    return safe_ratio(a, b) * 100


def int_avg(c: str | Column) -> Column:
    """AVG over integers truncates toward zero: integer division of an exact sum by the count."""
    return F.call_function("div", F.sum(col(c).cast("decimal(20,0)")), F.count(col(c)))


def money_sum(c: str | Column) -> Column:
    """Exact money sum (decimal inputs)."""
    return F.sum(col(c)).cast(MONEY_SUM)


def money_avg(c: str | Column, digits: int = 6) -> Column:
    """Average of a decimal column, as a double rounded to ``digits``."""
    return F.round(F.sum(col(c)).cast("double") / F.count(col(c)), digits)


def is_blank_len(c: str | Column) -> Column:
    """``LEN(x)``: length ignoring trailing blanks."""
    return F.length(F.rtrim(col(c)))


def year_diff(start: str | Column, end: str | Column) -> Column:
    """``DATEDIFF(YEAR, start, end)`` counts year boundaries."""
    return F.year(col(end)) - F.year(col(start))


def day_diff(start: str | Column, end: str | Column) -> Column:
    """``DATEDIFF(DAY, start, end)``."""
    return F.datediff(col(end), col(start))


def month_abbr(d: str | Column) -> Column:
    return F.date_format(col(d), "MMM")


def dow_name(d: str | Column) -> Column:
    return F.date_format(col(d), "E")


def dow_int(d: str | Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(col(d))


def is_weekend(d: str | Column) -> Column:
    return dow_int(d).isin(1, 7)


def year_range(d: str | Column, first: int, last: int) -> Column:
    """``YEAR(d) BETWEEN first AND last`` written as a date range (prunable)."""
    return (col(d) >= F.lit(f"{first:04d}-01-01").cast("date")) & \
           (col(d) < F.lit(f"{last + 1:04d}-01-01").cast("date"))


def in_years(d: str | Column, years: Sequence[int]) -> Column:
    """``YEAR(d) IN (years)``: a range test when the years are contiguous."""
    ys = sorted(set(years))
    if ys == list(range(ys[0], ys[-1] + 1)):
        return year_range(d, ys[0], ys[-1])
    return F.year(col(d)).isin(*ys)


def price_band(price: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Searched CASE without ELSE: ``= edges[0]`` is the first label, then
    ``(edges[i-1], edges[i]]`` bands; anything else is NULL."""
    p = col(price)
    e = F.when(p == edges[0], F.lit(labels[0]))
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels[1:]):
        e = e.when((p > lo) & (p <= hi), F.lit(lab))
    return e


def seeded_key(seed: str, key: str | Column) -> Column:
    """Reproducible random order: md5 of seed and key (same digest in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))


def concat_text(*parts: str | Column) -> Column:
    """T-SQL CONCAT: NULL parts count as empty strings."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def r(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def as_long(c: str | Column) -> Column:
    return col(c).cast("bigint")
