"""Operator-level tests: skew-safe rewrites equal their naive forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hrlens.operators.aggregates import two_group_gap, weighted_mean_micro
from hrlens.operators.rates import bucketize, rate
from hrlens.operators.windows import change_from_previous, global_rank, top_n_per_group, vs_group_mean
from hrlens.sources.derive import hr_views


def test_split_lag_equals_plain_lag_on_real_data(spark, sf01):
    sal = hr_views(spark, sf01).salaries
    order = ["effective_date", "salary_id"]
    plain = change_from_previous(sal, "employee_id", order, "monthly_salary_idr", "p")
    split = change_from_previous(sal, "employee_id", order, "monthly_salary_idr", "p", split=F.year("effective_date"))
    a = plain.select("salary_id", "p").exceptAll(split.select("salary_id", "p")).count()
    b = split.select("salary_id", "p").exceptAll(plain.select("salary_id", "p")).count()
    assert a == 0 and b == 0 and split.count() == sal.count()


def test_split_lag_hot_key_and_null_dates(spark):
    # One key holds most rows, across years, with NULL dates and a NULL key.
    data = [(i, 1, None if i % 17 == 0 else f"20{10 + i % 12}-0{1 + i % 9}-1{i % 10}", i * 10) for i in range(300)]
    data += [(1000 + i, 2, "2020-01-01", i) for i in range(3)]
    data += [(2000, None, "2020-01-01", 5), (2001, None, "2021-01-01", 6)]
    df = spark.createDataFrame(data, "id long, k long, d string, v long").withColumn("d", F.to_date("d"))
    plain = change_from_previous(df, "k", ["d", "id"], "v", "p")
    split = change_from_previous(df, "k", ["d", "id"], "v", "p", split=F.year("d"))
    assert sorted(plain.select("id", "p").collect()) == sorted(split.select("id", "p").collect())


def test_global_rank_equals_window_rank(spark):
    df = spark.range(500).select(F.col("id"), ((F.col("id") * 7919) % 37).alias("m"))
    df = df.withColumn("m", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("m")))
    ours = global_rank(df, "m", "r")
    ref = df.withColumn("r", F.rank().over(Window.orderBy(F.col("m").desc_nulls_first())))
    assert sorted(ours.select("id", "r").collect()) == sorted(ref.select("id", F.col("r").cast("bigint").alias("r")).collect())


def test_vs_group_mean_matches_null_group(spark):
    df = spark.createDataFrame(
        [(1, "a", 10), (2, "a", 21), (3, None, 5), (4, None, 6), (5, "b", None)], "id long, g string, v long"
    )
    got = {r.id: r.m for r in vs_group_mean(df, ["g"], "v", "m").collect()}
    assert got == {1: 16, 2: 16, 3: 6, 4: 6, 5: None}


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, "a", 3), (5, "b", 1)], "id long, g string, v long")
    got = sorted(r.id for r in top_n_per_group(df, ["g"], F.col("v").desc_nulls_first(), 2, "r").collect())
    assert got == [1, 2, 5]


def test_rate_and_bucketize(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,), (9.0,)], "t double")
    labels = [r[0] for r in df.select(bucketize(F.col("t"), [(1, "a"), (3, "b")], "z")).collect()]
    assert labels == ["a", "b", "z", "z"]
    r = rate(df, [], F.col("t") > 1).first()
    assert (r.headcount, r.resigned, r.attrition_rate) == (4, 2, 50.0)


def test_weighted_mean_rules(spark):
    df = spark.createDataFrame(
        [(1, 80.0, None), (1, 90.0, None), (2, 100.0, 50.0), (2, None, 50.0), (3, 85.5, 20.0), (3, 95.0, 30.0)],
        "e long, a double, w double",
    )
    got = {r.e: r.m for r in weighted_mean_micro(df, ["e"], "a", "w", "m").collect()}
    assert got == {1: 0, 2: 50_000_000, 3: 91_200_000}


def test_two_group_gap_direction(spark):
    df = spark.createDataFrame(
        [("x", "M", 100), ("x", "F", 110), ("y", "M", 100), ("y", "F", 100), ("z", "M", 5)], "lvl string, g string, v long"
    )
    got = {r.lvl: (r.pay_gap, r.pay_gap_pct, r.gap_direction) for r in
           two_group_gap(df, ["lvl"], "g", "M", "F", "v", "am", "af", "M higher", "F higher").collect()}
    assert got == {"x": (-10.0, 9.09, "F higher"), "y": (0.0, 0.0, "Equal"), "z": (None, 0.0, "Equal")}


def test_mean_sd_band_single_row_is_null(spark):
    from hrlens.operators.aggregates import mean_sd_band

    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = {r.g: (r.avg, r.sd, r.lo, r.hi) for r in df.groupBy("g").agg(*mean_sd_band(F.col("x"), 2, 1)).collect()}
    assert got == {"a": (3.0, None, None, None), "b": (3.0, 1.41, 1.59, 4.41)}


def test_forget_views_rebuilds(spark, sf001):
    from hrlens.sources.derive import forget_views, hr_views

    a = hr_views(spark, sf001)
    assert hr_views(spark, sf001) is a
    forget_views()
    b = hr_views(spark, sf001)
    assert b is not a and b.employees.count() == a.employees.count()


def test_salary_changes_split_grains_agree(spark, sf01):
    from hrlens.plans.analyses import salary_changes

    t = hr_views(spark, sf01)
    cols = ["full_name", "effective_date", "current_salary", "prev_salary", "salary_change", "change_reason"]
    plain = salary_changes(t, split=None).select(*cols)
    for grain in ("year", "month"):
        other = salary_changes(t, split=grain).select(*cols)
        assert plain.exceptAll(other).count() == 0 and other.exceptAll(plain).count() == 0
