"""Ordered work over groups of any size, by cut points.

A group with more rows than a task should hold is cut into pieces at quantiles
of its order. The quantiles come from a sample that the rows' own values
decide (a hash of the order columns), so every branch of a plan, and every
rerun after a lost executor, finds the same cuts, and nothing has to be
collected or written for it. What an ordered operator needs from beyond a
piece (the row before it, the count before it) is one row a piece.

* ``previous_value``: lag over groups of any size.
* ``rank_all``: rank() over a whole table.
* ``top_n_with_ties``: rank() <= n per group, however many rows tie.

Cases: a null key is a group of its own; null order values come last when
ascending and first when descending, as PostgreSQL orders them; rows that are
equal in all order columns stay in one piece; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pieces:
    """``hot_rows``: rows above which a group is cut. ``pieces``: most pieces
    of a group. ``sample``: sampled rows a piece, about."""

    hot_rows: int = 1_000_000
    pieces: int = 256
    sample: int = 20


def sort_key(order: list[str]) -> Column:
    """The order columns as one comparable value, nulls last."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"o{i}") for i, c in enumerate(order)])


def cut_points(df: DataFrame, key: Column, order: Column, rules: Pieces) -> DataFrame:
    """``_k, _cuts``: for each key with more than ``hot_rows`` rows its cuts
    in order. At most rows / ``hot_rows`` keys have any."""
    rows = df.select(key.alias("_k"), order.alias("_o"))
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rules.hot_rows)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / (rules.pieces * rules.sample)))
    sample = rows.join(sizes, "_k").where(F.pmod(F.xxhash64("_o"), every) == 0)
    found = sample.groupBy("_k").agg(F.sort_array(F.collect_set("_o")).alias("_s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("_s") / rules.pieces))
    return found.select("_k", F.filter("_s", lambda x, i: (i + 1) % step == 0).alias("_cuts"))


def piece(cuts: Column, order: Column, pieces: int) -> Column:
    """How many cuts lie before ``order``, by binary search; 0 without cuts."""
    steps = F.array(*[F.lit(1 << k) for k in range(pieces.bit_length(), -1, -1)])

    def onward(at: Column, step: Column) -> Column:
        fits = (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < order)
        return F.when(F.coalesce(fits, F.lit(False)), at + step).otherwise(at)

    return F.when(cuts.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), onward))


def previous_value(
    df: DataFrame, key: str, order: list[str], value: str, out: str = "prev_value", rules: Pieces = Pieces()
) -> DataFrame:
    """Add ``out`` = ``value`` of the row before, among rows of the same
    ``key`` ordered by ``order`` ascending, nulls last (null for the first).

    One shuffle carries the rows, by (key, piece). The first row of a piece
    takes the last value of the nearest piece before it; those values are an
    aggregate over the hot keys' rows alone, one row a piece."""
    base = df.withColumn("_k", F.struct(F.col(key))).withColumn("_o", sort_key(order))
    cuts = cut_points(df, F.struct(F.col(key)), sort_key(order), rules)
    dealt = base.join(cuts, "_k", "left").withColumn("_p", piece(F.col("_cuts"), F.col("_o"), rules.pieces)).drop("_cuts")
    within = Window.partitionBy("_k", "_p").orderBy("_o")
    local = dealt.withColumn("_lag", F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    hot = df.select(F.struct(F.col(key)).alias("_k"), sort_key(order).alias("_o"), F.col(value).alias("_v")).join(cuts, "_k")
    hot = hot.withColumn("_p", piece(F.col("_cuts"), F.col("_o"), rules.pieces))
    last = hot.groupBy("_k", "_p").agg(F.max_by("_v", "_o").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_p")
    carry = last.select("_k", "_p", F.lag("_last").over(before).alias("_carry"))
    joined = local.join(carry, ["_k", "_p"], "left")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).select(*df.columns, out)


def rank_all(df: DataFrame, metric: str, out: str = "rank", descending: bool = True, rules: Pieces = Pieces()) -> DataFrame:
    """rank() over (order by ``metric``) for every row, over any metric.

    Rows are counted per distinct value (combined map-side). The values are
    cut into ranges; a running count within each range and the counts of the
    ranges before it (``pieces`` rows) give the rank, which is joined back."""
    values = df.groupBy(F.col(metric).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("_m").isNull().alias("n"), F.col("_m").alias("v"))
    one = F.struct(F.lit(0))
    cuts = cut_points(values, one, order, rules).select("_cuts")
    dealt = values.withColumn("_o", order).withColumn("_cuts", cuts.scalar())
    dealt = dealt.withColumn("_p", piece(F.col("_cuts"), F.col("_o"), rules.pieces)).drop("_cuts")

    def way(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = Window.partitionBy("_p").orderBy(way("_o")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_p").agg(F.sum("_n").alias("_all"))
    outside = Window.orderBy(way("_p")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranges.select("_p", F.coalesce(F.sum("_all").over(outside), F.lit(0)).alias("_before"))
    counted = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, "_p")
    ranks = counted.select("_m", (F.col("_before") + F.col("_in") + 1).cast("bigint").alias(out))
    return df.join(ranks, F.col(metric).eqNullSafe(F.col("_m"))).select(*df.columns, out)


def top_n_with_ties(
    df: DataFrame, by: list[str], value: str, n: int, out: str = "rank", descending: bool = True
) -> DataFrame:
    """Rows whose rank() within ``by`` by ``value`` is at most ``n``.

    Rows are counted per (group, value), map-side combined; a window limited
    to ``n`` values a group before its shuffle finds the values that rank and
    their ranks, which are joined back to the rows. No window holds rows, so a
    group of which a third of the table ties at the top is no task's alone."""
    keys = [F.struct(F.col(c)).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    base = df.select("*", *keys, F.struct(F.col(value)).alias("_m"))
    counts = base.groupBy(*names, "_m").agg(F.count(F.lit(1)).alias("_n"))
    plain = F.col("_m").getField(value)
    order = plain.desc_nulls_first() if descending else plain.asc_nulls_last()
    groups = Window.partitionBy(*names).orderBy(order)
    first = counts.withColumn("_i", F.row_number().over(groups)).where(F.col("_i") <= n)
    running = F.coalesce(F.sum("_n").over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = first.withColumn(out, (running + 1).cast("bigint")).where(F.col(out) <= n).drop("_n", "_i")
    return base.join(ranks, [*names, "_m"]).select(*df.columns, out)
