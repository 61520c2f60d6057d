"""A key holding a third of all rows: results stay exact and the hot key's
rows are spread over many tasks where the plan promises it."""

from pyspark.sql import functions as F

from hrlens.operators.hierarchy import direct_report_counts
from hrlens.operators.windows import change_from_previous, top_n_per_group, vs_group_mean

N = 30_000


def _salaries(spark):
    # employee 7 owns a third of all rows, spread over 30 years.
    ids = spark.range(N).select(
        F.col("id").alias("salary_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997 + 100).alias("employee_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 7 % 10950).cast("int")).alias("effective_date"),
        (F.col("id") * 31 % 100_000).alias("monthly_salary_idr"),
    )
    return ids


def test_split_lag_spreads_hot_key(spark):
    sal = _salaries(spark)
    order = ["effective_date", "salary_id"]
    split = change_from_previous(sal, "employee_id", order, "monthly_salary_idr", "p", split=F.year("effective_date"))
    plain = change_from_previous(sal, "employee_id", order, "monthly_salary_idr", "p")
    assert split.select("salary_id", "p").exceptAll(plain.select("salary_id", "p")).count() == 0

    def hot_rows_per_task(df):
        # The partition id is taken before filtering (a non-deterministic
        # column keeps the filter above the window's exchange).
        return [
            r["n"]
            for r in df.withColumn("pid", F.spark_partition_id())
            .where(F.col("employee_id") == 7)
            .groupBy("pid")
            .agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("_keep_window"))
            .collect()
        ]

    # The plain window puts every row of the hot key in one task; the split
    # window spreads them (30 yearly groups over the shuffle partitions).
    # Coalescing is off while measuring: at this size AQE would otherwise
    # merge every partition into one.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert max(hot_rows_per_task(plain)) == N // 3
        assert max(hot_rows_per_task(split)) < N // 6
    finally:
        spark.conf.set(key, before)


def test_hot_manager_and_hot_department(spark):
    # One manager with a third of all employees as reports; one department
    # with a third of all rows.
    emp = spark.range(1, N + 1).select(
        F.col("id").alias("employee_id"),
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("full_name"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("bigint").alias("dept_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") > 1, F.col("id") - 1).cast("bigint").alias("manager_id"),
        F.lit("Active").alias("status"),
        (F.col("id") % 1000).alias("monthly_salary_idr"),
        F.when(F.col("id") % 2 == 0, "Mid").otherwise("Senior").alias("job_level"),
    )
    depts = spark.range(1, 60).select(
        F.col("id").alias("dept_id"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("dept_name")
    )
    counts = {r.full_name: (r.total_subordinates, r.rank_by_subordinates) for r in direct_report_counts(emp, depts).collect()}
    assert counts["E1"] == (N // 3 + 1, 1)  # the third plus employee 2
    assert sum(c for c, _ in counts.values()) == N - 1
    top = top_n_per_group(emp, ["dept_id"], F.col("monthly_salary_idr").desc_nulls_first(), 3, "r")
    assert top.where(F.col("dept_id") == 1).count() >= 3
    means = vs_group_mean(emp, ["dept_id", "job_level"], "monthly_salary_idr", "m")
    assert means.count() == N


def test_building_queries_runs_no_job(spark, sf001):
    import __spark_entry__ as E

    built = [k for k in E.queries() if not k.startswith("op") and k != "pipeline"]
    E.queries()["q01_headcount_by_department"](spark, sf001)  # lists the files once
    for t in ("nation", "region", "customer", "orders", "events", "lineitem", "supplier"):
        spark.read.parquet(f"{sf001}/{t}.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("building", "plans only")
    try:
        for k in built:
            E.queries()[k](spark, sf001)
        jobs = sc.statusTracker().getJobIdsForGroup("building")
        infos = [sc.statusTracker().getJobInfo(j) for j in jobs]
        stages = [sc.statusTracker().getStageInfo(s).name for i in infos if i for s in i.stageIds]
        # Reading a Parquet footer for the schema is the only thing that runs.
        assert all(n.startswith("parquet at") for n in stages), stages
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
