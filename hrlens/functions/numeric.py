"""Exact arithmetic helpers.

Rates and averages are rounded half away from zero on exact integers, never
on binary doubles, so the result does not depend on partial-sum order and
equals PostgreSQL ``round(numeric, n)`` (and a DuckDB cross-check written with
the same integer formula).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"
UNITS = 6  # decimals a measure may carry: scores, weights, achievements, bands


def idiv(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero (SQL ``a div b``)."""
    return F.call_function("div", a, b)


def as_int(c: Column, digits: int = 0) -> Column:
    """``c`` times 10^digits as an exact integer (for values with at most
    ``digits`` decimals, e.g. scores in tenths or money in cents)."""
    if digits == 0:
        return F.round(c).cast("bigint")
    return F.round(c * (10**digits)).cast("bigint")


def exact_units(c: Column, digits: int = UNITS) -> Column:
    """``c`` times 10^digits as an exact integer, for measures that are summed.

    A value with more decimals than that raises an error: no input is ever
    rounded."""
    scaled = F.rint(c * 10**digits).cast("bigint") if digits else c.cast("bigint")
    same = c == (scaled / 10**digits if digits else scaled)
    message = F.concat(F.lit(f"more than {digits} decimals: "), c.cast("string"))
    return F.when(c.isNull() | same, scaled).otherwise(F.raise_error(message).cast("bigint"))


def half_up_int(num: Column, den: Column, digits: int = 0) -> Column:
    """round(num / den * 10^digits) half away from zero, as a BIGINT.

    ``num`` and ``den`` are integral Columns. NULL when ``den`` is 0 or NULL.
    """
    n = num.cast(DEC)
    d = den.cast(DEC)
    q = idiv(F.abs(n) * (2 * 10**digits) + F.abs(d), F.abs(d) * 2)
    negative = (n < 0) != (d < 0)
    return F.when(d != 0, F.when(negative, -q).otherwise(q)).cast("bigint")


def half_up_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """round(num / den, digits) half away from zero, as a DOUBLE."""
    scaled = half_up_int(num, den, digits)
    if digits == 0:
        return scaled.cast("double")
    return (scaled.cast(DEC) / F.lit(10**digits).cast(DEC)).cast("double")


def pct(hits: Column, total: Column, digits: int = 2) -> Column:
    """round(100 * hits / total, digits): a percentage of integer counts."""
    return half_up_ratio(hits.cast(DEC) * 100, total, digits)


def avg_rounded(c: Column, digits: int, input_digits: int = UNITS) -> Column:
    """Aggregate: round(avg(c), digits) exactly.

    ``input_digits`` is the number of decimals the values may carry (0 for IDR
    amounts); they are summed as 38-digit decimals in those units and only the
    result is rounded.
    """
    s = F.sum(exact_units(c, input_digits).cast(DEC))
    n = F.count(c).cast(DEC) * (10**input_digits)
    return half_up_ratio(s, n, digits)
