"""Aggregate operators: weighted means, two-group gaps, mean/stddev bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.functions.numeric import DEC, UNITS, exact_units, half_up_int, half_up_ratio
from hrlens.schemas import EQUAL

MICRO = 6  # per-entity weighted means are kept as exact integers in 1e-6 units


def weighted_mean_micro(
    df: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    out: str = "weighted_mean_micro",
    input_digits: int = UNITS,
) -> DataFrame:
    """Per group: coalesce(sum(value*weight) / nullif(sum(weight), 0), 0),
    held as an exact integer in 10^-6 units.

    A NULL weight drops the row from both sums; a NULL value only from the
    numerator; all-NULL or zero weights give 0. Values and weights of up to
    ``input_digits`` decimals (more raise an error) are summed exactly, so the
    result does not depend on row order. A group holding a third of all rows
    is still combined map-side (partial aggregation)."""
    v = exact_units(F.col(value), input_digits).cast("decimal(18,0)")
    w = exact_units(F.col(weight), input_digits).cast("decimal(18,0)")
    num = F.sum(v * w)
    den = F.sum(w.cast(DEC)) * (10**input_digits)
    mean = F.coalesce(half_up_int(num, den, MICRO), F.lit(0).cast("bigint"))
    return df.groupBy(*by).agg(mean.alias(out))


def mean_of_micro(c: Column, digits: int = 2) -> Column:
    """Aggregate: round(avg(c / 10^6), digits) for a micro-unit integer column."""
    return half_up_ratio(F.sum(c.cast(DEC)), F.count(c) * (10**MICRO), digits)


def two_group_gap(
    df: DataFrame,
    by: list[str],
    group_col: str,
    a: str,
    b: str,
    value: str,
    a_name: str,
    b_name: str,
    a_higher: str,
    b_higher: str,
) -> DataFrame:
    """Mean of ``value`` for group ``a`` and ``b`` side by side, their gap and
    the gap as a percentage of the higher side.

    Output: by..., <a_name>, <b_name>, pay_gap, pay_gap_pct, gap_direction.
    Means and gap are rounded to whole units from the unrounded means; the
    percentage divides by the *rounded* mean of the higher side; a group
    missing one side has direction ``Equal`` and percentage 0."""
    g = F.col(group_col)
    x = F.col(value).cast("bigint")
    d = x.cast(DEC)
    sa, na = F.sum(F.when(g == a, d)), F.count(F.when(g == a, x))
    sb, nb = F.sum(F.when(g == b, d)), F.count(F.when(g == b, x))
    stats = df.where(g.isin(a, b)).groupBy(*by).agg(
        sa.alias("_sa"), na.alias("_na"), sb.alias("_sb"), nb.alias("_nb")
    )
    # Per-group arithmetic in 38-digit decimals (sum x count can pass 2^63).
    cross = F.col("_sa").cast(DEC) * F.col("_nb").cast(DEC) - F.col("_sb").cast(DEC) * F.col("_na").cast(DEC)
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    direction = (
        F.when(both & (cross > 0), a_higher)
        .when(both & (cross < 0), b_higher)
        .otherwise(EQUAL)
    )
    mean_a = half_up_int(F.col("_sa"), F.col("_na"), 0)
    mean_b = half_up_int(F.col("_sb"), F.col("_nb"), 0)
    gap = F.when(both, half_up_int(cross, F.col("_na").cast(DEC) * F.col("_nb"), 0))
    gap_pct = (
        F.when(F.col("gap_direction") == a_higher, half_up_ratio(F.abs("pay_gap") * 100, F.col("_ma"), 2))
        .when(F.col("gap_direction") == b_higher, half_up_ratio(F.abs("pay_gap") * 100, F.col("_mb"), 2))
        .otherwise(F.lit(0.0))
    )
    return (
        stats.select(
            *by,
            mean_a.alias("_ma"),
            mean_b.alias("_mb"),
            gap.alias("pay_gap"),
            direction.alias("gap_direction"),
        )
        .withColumn("pay_gap_pct", gap_pct)
        .select(
            *by,
            F.col("_ma").cast("double").alias(a_name),
            F.col("_mb").cast("double").alias(b_name),
            F.col("pay_gap").cast("double").alias("pay_gap"),
            "pay_gap_pct",
            "gap_direction",
        )
    )


def mean_sd_band(c: Column, digits: int = 2, input_digits: int = UNITS) -> list[Column]:
    """Aggregates: rounded mean, rounded sample stddev and mean -/+ stddev
    (from the unrounded values).

    Sums run on exact integers; the variance is one exact rational turned
    into a double once, so the result does not depend on partial-sum order.
    One row gives NULL stddev and bounds."""
    xi = exact_units(c, input_digits).cast("decimal(18,0)")
    s = F.sum(xi).cast(DEC)
    q = F.sum(xi * xi).cast(DEC)
    n = F.count(c).cast(DEC)
    unit = 10**input_digits
    var_num = n * q - s * s
    var_den = n * (n - 1) * (unit * unit)
    sd = F.sqrt(F.when(n > 1, var_num.cast("double") / var_den.cast("double")))
    mean = s.cast("double") / (n * unit).cast("double")
    return [
        half_up_ratio(s, n * unit, digits).alias("avg"),
        F.round(sd, digits).alias("sd"),
        F.round(mean - sd, digits).alias("lo"),
        F.round(mean + sd, digits).alias("hi"),
    ]
