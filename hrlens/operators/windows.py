"""Window-style operators written to stay distributed under skew.

* ``top_n_per_group``: rank() <= n keeps ties; Catalyst inserts a partial
  WindowGroupLimit before the shuffle, so a hot group ships only its local
  top rows.
* ``vs_group_mean``: the group mean is an aggregate (map-side combined)
  joined back instead of a window over the whole group (one task per group).
* ``change_from_previous``: previous value per key with an optional split
  column (e.g. year) so one hot key is spread over many tasks; the first row
  of each split takes the last value of the key's previous split.
* ``global_rank``: rank() over the whole table without a single-partition
  window: a histogram of the metric (at most ~sqrt(2N) distinct values for
  counts summing to N) gets running sums and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrlens.functions.numeric import DEC, half_up_int


def top_n_per_group(
    df: DataFrame,
    by: list[str],
    order: Column,
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Rows whose rank() within ``by`` ordered by ``order`` is <= n (ties kept)."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        df.withColumn(rank_col, F.rank().over(w).cast("bigint"))
        .where(F.col(rank_col) <= n)
    )


def group_mean_int(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """round(avg(value)) per group as an exact BIGINT (NULL for all-NULL)."""
    x = F.col(value).cast("bigint")
    return df.groupBy(*by).agg(half_up_int(F.sum(x.cast(DEC)), F.count(x), 0).alias(out))


def vs_group_mean(
    df: DataFrame,
    by: list[str],
    value: str,
    mean_col: str = "group_mean",
) -> DataFrame:
    """Attach the rounded group mean of ``value`` to every row.

    Grouping keys match NULL to NULL, like a window partition."""
    means = group_mean_int(df, by, value, mean_col)
    means = means.select(*[F.col(k).alias(f"_k_{k}") for k in by], mean_col)
    cond = None
    for k in by:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    joined = df.join(means, cond, "left")
    return joined.drop(*[f"_k_{k}" for k in by])


def date_split(d: Column, grain: str | None) -> Column | None:
    """A split column for ``change_from_previous`` that sorts like the date:
    ``"year"``, ``"month"`` (yyyymm) or ``None`` for no split."""
    if grain is None:
        return None
    if grain == "year":
        return F.year(d)
    if grain == "month":
        return F.year(d) * 100 + F.month(d)
    raise ValueError(f"unknown split grain {grain!r}")


def change_from_previous(
    df: DataFrame,
    key: str,
    order: list[str],
    value: str,
    prev_col: str = "prev_value",
    split: Column | None = None,
) -> DataFrame:
    """Add ``prev_col`` = value of the previous row of the same ``key`` when
    rows are ordered by ``order`` ascending, NULLs last (NULL for the first
    row): lag(value) over (partition by key order by ...).

    With ``split`` (a coarse column that sorts like ``order[0]``, such as the
    year of the order date), rows are windowed per (key, split) so one hot
    key is spread over many tasks; each split's first row then takes the last
    value of the key's nearest earlier split, found from a per-(key, split)
    aggregate that is combined map-side."""
    sort = [F.col(c).asc_nulls_last() for c in order]
    if split is None:
        w = Window.partitionBy(key).orderBy(*sort)
        return df.withColumn(prev_col, F.lag(value).over(w))

    # Struct-wrapped keys compare NULL equal to NULL, so NULL keys and NULL
    # splits keep their own groups in a plain equi-join; (is_null, value)
    # puts a NULL split last. The fix-up join uses exactly the window's
    # partitioning keys, so the rows are shuffled once.
    base = df.withColumn("_kk", F.struct(F.col(key))).withColumn(
        "_sk", F.struct(split.isNull().alias("n"), split.alias("v"))
    )
    w = Window.partitionBy("_kk", "_sk").orderBy(*sort)
    local = base.withColumn("_lag", F.lag(value).over(w)).withColumn(
        "_pos", F.row_number().over(w)
    )
    # Last row per (key, split) under the same ordering; NULLs sort last, so
    # the sort key of each column is (is_null, value). Aggregating the source
    # (combined map-side, one row per (key, split) per task) ships far less
    # than regrouping the window's output, whose exchange would carry every
    # row a second time with a different column set (no exchange reuse).
    sort_key = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    tails = base.groupBy("_kk", "_sk").agg(F.max_by(F.col(value), sort_key).alias("_tail"))
    carry = tails.select(
        "_kk", "_sk", F.lag("_tail").over(Window.partitionBy("_kk").orderBy("_sk")).alias("_carry")
    )
    return (
        local.join(carry, ["_kk", "_sk"], "left")
        .withColumn(prev_col, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_kk", "_sk", "_lag", "_pos", "_carry")
    )


def global_rank(
    df: DataFrame,
    metric: str,
    rank_col: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """rank() over (order by metric [desc]) for every row, without moving all
    rows into one partition. NULL metrics rank as PostgreSQL orders them
    (first when descending, last when ascending).

    Counts of disjoint rows of a table of N rows have fewer than sqrt(2N) + 2
    distinct values (about 141k for N = 10^10): the histogram stays small."""
    hist = df.groupBy(metric).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(metric).desc_nulls_first() if descending else F.col(metric).asc_nulls_last()
    # The histogram is bounded by the number of distinct metric values, so a
    # single ordered window over it is cheap.
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.withColumn(
        rank_col, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("bigint")
    ).select(F.col(metric).alias("_m"), rank_col)
    return df.join(ranks, F.col(metric).eqNullSafe(F.col("_m")), "inner").drop("_m")
