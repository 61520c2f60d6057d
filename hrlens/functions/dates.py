"""Date arithmetic: tenure in completed years, fractional years."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def completed_years(start: Column, end: Column) -> Column:
    """Whole years from ``start`` to ``end`` (PostgreSQL
    ``extract(year from age(end, start))``): 2020-02-29 -> 2021-02-28 is 0,
    negative spans truncate toward zero."""
    return F.timestamp_diff("YEAR", start, end)


def tenure_end(termination: Column, snapshot: _dt.date) -> Column:
    """Last day counted for tenure: termination date, else the snapshot."""
    return F.coalesce(termination, F.lit(snapshot))


def fractional_years(start: Column, end: Column) -> Column:
    """Days between / 365.25 (the simulator's tenure; not completed years)."""
    return F.datediff(end, start) / F.lit(365.25)
