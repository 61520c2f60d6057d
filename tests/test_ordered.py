"""Ordered operators over hot groups: equal to the plain windows, and spread
over tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hrlens.operators.ordered import Pieces, cut_points, piece, previous_value, rank_all, sort_key, top_n_with_ties

N = 24_000
SMALL = Pieces(hot_rows=500, pieces=32)
ORDER = ["effective_date", "salary_id"]


@pytest.fixture(scope="module")
def salaries(spark):
    """Half of all rows in one (employee, year), most of them on one day; a
    null employee with a sixth; null dates, ids and salaries."""
    i = F.col("id")
    return spark.range(N).select(
        F.when(i % 101 != 0, i).alias("salary_id"),
        F.when(i % 2 == 0, F.lit(7)).when(i % 3 == 0, F.lit(None)).otherwise(i % 997 + 100).cast("long").alias("employee_id"),
        F.when(i % 97 == 0, F.lit(None))
        .when((i % 2 == 0) & (i % 10 != 0), F.lit("2020-05-05").cast("date"))
        .otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (i * 7 % 300).cast("int")))
        .alias("effective_date"),
        F.when(i % 89 != 0, i * 31 % 1000).alias("monthly_salary_idr"),
        F.monotonically_increasing_id().alias("_o"),  # a clashing name
    ).drop("_o")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("rules", [SMALL, Pieces(), Pieces(hot_rows=0, pieces=3)])
def test_previous_value_is_lag(spark, salaries, rules):
    df = salaries.where("salary_id is not null")  # ties in all order columns have no order
    w = Window.partitionBy("employee_id").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    plain = df.withColumn("p", F.lag("monthly_salary_idr").over(w))
    assert same(previous_value(df, "employee_id", ORDER, "monthly_salary_idr", "p", rules), plain)


def test_hot_history_is_spread(spark, salaries):
    """The hot employee's year is no task's alone: its largest piece is at
    most twice the mean piece."""
    key, order = F.struct(F.col("employee_id")), sort_key(ORDER)
    cuts = cut_points(salaries, key, order, SMALL)
    assert sorted((r._k.employee_id is None, r._k.employee_id) for r in cuts.collect()) == [(False, 7), (True, None)]
    dealt = salaries.withColumn("_k", key).withColumn("_o", order).join(cuts, "_k")
    hot = dealt.where("employee_id = 7").groupBy(piece(F.col("_cuts"), F.col("_o"), SMALL.pieces).alias("p")).count()
    n = [r["count"] for r in hot.collect()]
    assert len(n) >= 24 and max(n) <= 2 * sum(n) / len(n)


def test_piece_counts_cuts(spark):
    df = spark.range(-3, 40).select(F.struct("id").alias("o"), F.array(*[F.struct(F.lit(3 * k).cast("long").alias("id")) for k in range(11)]).alias("c"))
    for r in df.select("o", piece(F.col("c"), F.col("o"), 16).alias("p"), piece(F.lit(None).cast("array<struct<id:long>>"), F.col("o"), 16).alias("none")).collect():
        assert r.p == sum(3 * k < r.o.id for k in range(11)) and r.none == 0


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("metric", ["monthly_salary_idr", "salary_id", "effective_date"])
def test_rank_all_is_rank(spark, salaries, metric, descending):
    order = F.col(metric).desc_nulls_first() if descending else F.col(metric).asc_nulls_last()
    plain = salaries.withColumn("r", F.rank().over(Window.orderBy(order)).cast("bigint"))
    for rules in (Pieces(hot_rows=50, pieces=16), Pieces()):
        assert same(rank_all(salaries, metric, "r", descending, rules), plain)


def test_rank_all_has_no_single_partition_over_rows(spark, salaries):
    plan = rank_all(salaries, "salary_id", "r")._jdf.queryExecution().executedPlan().toString()
    # one row a range, and the cuts
    assert "Window [rank" not in plan and "Python" not in plan


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_with_a_flood_of_ties(spark, n):
    """A department whose salaries are all null ties at rank 1; so does one
    with a single salary; a null department is a group."""
    i = F.col("id")
    df = spark.range(6000).select(
        i.alias("e"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(i % 4).cast("int").alias("dept_id"),
        F.when(i % 4 == 1, F.lit(None)).when(i % 4 == 2, F.lit(5)).otherwise(i * 37 % 400).cast("long").alias("pay"),
    )
    for down in (True, False):
        order = F.col("pay").desc_nulls_first() if down else F.col("pay").asc_nulls_last()
        plain = df.withColumn("r", F.rank().over(Window.partitionBy("dept_id").orderBy(order)).cast("bigint")).where(F.col("r") <= n)
        got = top_n_with_ties(df, ["dept_id"], "pay", n, "r", down)
        assert same(got, plain)
    assert got.where("dept_id = 1").count() > 1000


def test_no_rows(spark, salaries):
    none = salaries.limit(0)
    assert previous_value(none, "employee_id", ORDER, "monthly_salary_idr", rules=SMALL).count() == 0
    assert rank_all(none, "salary_id").count() == 0
    assert top_n_with_ties(none, ["employee_id"], "salary_id", 3).count() == 0
