"""Rate and bucket operators (count, filtered count, exact percentage)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.functions.dates import completed_years, tenure_end
from hrlens.functions.numeric import pct
from hrlens.schemas import SNAPSHOT, TENURE_BUCKETS, TENURE_ELSE


def rate_aggs(
    hit: Column,
    total_name: str = "headcount",
    hits_name: str = "resigned",
    rate_name: str = "attrition_rate",
    digits: int = 2,
) -> list[Column]:
    """``count(*)``, ``count(*) FILTER (WHERE hit)`` and
    ``round(100.0 * hits / total, digits)`` as aggregate Columns.

    The percentage is NULL on an empty group instead of raising."""
    total = F.count(F.lit(1))
    hits = F.count_if(hit)
    return [
        total.alias(total_name),
        hits.alias(hits_name),
        pct(hits, total, digits).alias(rate_name),
    ]


def rate(df: DataFrame, by: list[str], hit: Column, **names) -> DataFrame:
    """Grouped rate: one row per ``by`` group (or one row when ``by`` is empty)."""
    aggs = rate_aggs(hit, **names)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def bucketize(c: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """CASE WHEN c < b1 THEN l1 WHEN c < b2 THEN l2 ... ELSE otherwise.

    NULL input falls through to ``otherwise`` (SQL CASE semantics)."""
    expr = None
    for bound, label in bounds:
        expr = F.when(c < bound, label) if expr is None else expr.when(c < bound, label)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


def with_tenure(emp: DataFrame, snapshot: _dt.date = SNAPSHOT, name: str = "tenure_years") -> DataFrame:
    """Add completed years from hire to termination (or snapshot)."""
    return emp.withColumn(
        name,
        completed_years(F.col("hire_date"), tenure_end(F.col("termination_date"), snapshot)),
    )


def tenure_bucket(c: Column) -> Column:
    return bucketize(c, TENURE_BUCKETS, TENURE_ELSE)
