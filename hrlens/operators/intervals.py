"""Joins of intervals with points or intervals of a table, by buckets.

Each interval is cut into fixed bins of days and meets the other side in an
equi-join on the bin; the exact test follows. A pair that shares several bins
is kept in the first of them only, so no distinct is needed. A calendar may so
be a table of any length: no literal in the plan and no nested-loop join.

A long interval gives a row a bin; ``bin_days`` near the usual length keeps
that to a few rows each. A bin that a third of all intervals meet is a hot key
on one side, which AQE splits.

Cases: a null or reversed bound contains nothing; equal bounds hold one day;
repeated rows pair as often as they are there; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(day: Column, bin_days: int) -> Column:
    return F.floor(F.unix_date(day) / bin_days).cast("int")


def containing(spans: DataFrame, start: str, stop: str, points: DataFrame, point: str, bin_days: int = 365) -> DataFrame:
    """All pairs of ``spans`` and ``points`` with start <= point <= stop."""
    bins = F.sequence(_bin(F.col(start), bin_days), _bin(F.col(stop), bin_days))
    left = spans.where(F.col(start) <= F.col(stop)).select("*", F.explode(bins).alias("_bin"))
    right = points.where(F.col(point).isNotNull()).withColumn("_bin", _bin(F.col(point), bin_days))
    return left.join(right, "_bin").where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(stop))).drop("_bin")


def overlapping(
    left: DataFrame, l_start: str, l_stop: str, right: DataFrame, r_start: str, r_stop: str, bin_days: int = 365
) -> DataFrame:
    """All pairs whose closed intervals share a day."""

    def binned(df: DataFrame, a: str, b: str, first: str) -> DataFrame:
        lo = _bin(F.col(a), bin_days)
        return df.where(F.col(a) <= F.col(b)).select("*", lo.alias(first), F.explode(F.sequence(lo, _bin(F.col(b), bin_days))).alias("_bin"))

    pairs = binned(left, l_start, l_stop, "_l").join(binned(right, r_start, r_stop, "_r"), "_bin")
    shared = F.col("_bin") == F.greatest("_l", "_r")  # the first bin that both have
    return pairs.where(shared & (F.col(l_start) <= F.col(r_stop)) & (F.col(r_start) <= F.col(l_stop))).drop("_bin", "_l", "_r")
