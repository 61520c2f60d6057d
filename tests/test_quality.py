"""Validation checks (one passing and one failing case each) and profiling."""

import pytest
from pyspark.sql import functions as F

from hrlens.operators import profiling as P
from hrlens.operators import quality as V


def _emp(spark, rows):
    return spark.createDataFrame(
        rows, "employee_id long, dept_id long, manager_id long, gender string, monthly_salary_idr long"
    )


GOOD = [(1, 1, None, "Male", 10), (2, 1, 1, "Female", 20), (3, 2, 1, "Unknown", None)]
BAD = GOOD + [(3, 9, 42, None, 0), (4, None, None, "x", -5)]


def test_reference_checks_pass_on_clean_rows(spark, hr):
    dept = hr.departments
    assert V.validate_reference(_emp(spark, GOOD), dept).count() == 0
    V.assert_valid(V.validate_reference(_emp(spark, GOOD), dept))


def test_reference_checks_find_planted_faults(spark, hr):
    got = {(r.check, r.row_key) for r in V.validate_reference(_emp(spark, BAD), hr.departments).collect()}
    assert got == {
        ("unique:employee_id", "3"),
        ("fk:dept_id->departments.dept_id", "9"),
        ("fk:manager_id->employees.employee_id", "42"),
        ("domain:gender", "3"),
        ("domain:gender", "4"),
        ("positive:monthly_salary_idr", "3"),
        ("positive:monthly_salary_idr", "4"),
    }
    with pytest.raises(V.ValidationError):
        V.assert_valid(V.validate_reference(_emp(spark, BAD), hr.departments))


def test_extended_checks_on_fixture(hr):
    got = V.validate_extended(hr).collect()
    # Fixture reviewer ids exist; every score and achievement is in range.
    assert got == []


def test_profiling(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", None), ("b", "x"), (None, "y"), (None, "y")], "c1 string, c2 string"
    )
    d = P.duplicate_rows(df, "t").first()
    assert (d.rows, d.duplicate_rows) == (5, 2)
    assert {(r.c1, r.rows) for r in P.value_counts(df, "c1").collect()} == {("a", 2), ("b", 1), (None, 2)}
    assert sorted(r.c1 for r in P.distinct_values(df, "c1").collect()) == ["a", "b"]
    assert {(r.column_name, r.missing) for r in P.missing_counts(df).collect()} == {("c1", 2), ("c2", 2)}
    assert P.shape(df, "t").first().asDict() == {"table_name": "t", "rows": 5, "cols": 2}
    mm = P.min_max(df, "c1").first()
    assert (mm.min_value, mm.max_value) == ("a", "b")
    assert [r.c1 for r in P.head(df.where(F.col("c1").isNotNull()), 2, ["c1"]).collect()] == ["a", "a"]
    assert P.dtypes(spark, df).count() == 2


def test_dedupe_runs_on_raw_strings_so_v1_catches_late_duplicates(spark, hr):
    from hrlens.operators.cleaning import clean_employees
    from hrlens.schemas import TABLE_COLUMNS

    cols = TABLE_COLUMNS["employees"]
    base = dict.fromkeys(cols)
    base.update(employee_id="7", full_name="ani", gender="F", dept_id="1", status="Active", hire_date="2020-01-01")
    same = dict(base)
    variant = dict(base, full_name="  ANI ")  # equal only after cleaning
    raw = spark.createDataFrame([tuple(r[c] for c in cols) for r in (base, same, variant)], ", ".join(f"{c} string" for c in cols))
    clean = clean_employees(raw)
    assert clean.count() == 2  # the exact copy is dropped, the variant survives
    got = V.key_unique(clean, "employees", ["employee_id"]).collect()
    assert [(r.row_key, r.detail) for r in got] == [("7", "rows=2")]


def test_in_ranges_single_pass_equals_separate_checks(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 3.0), (2, 3.0, 6.0), (3, 9.0, 0.0), (4, None, 2.0)], "id long, a double, b double"
    )
    together = V.in_ranges(df, "t", "id", {"a": (1.0, 5.0), "b": (1.0, 5.0)})
    apart = V.in_range(df, "t", "id", "a", 1.0, 5.0).unionByName(V.in_range(df, "t", "id", "b", 1.0, 5.0))
    assert sorted(together.collect()) == sorted(apart.collect())
    assert together.count() == 4


def test_keys_and_rows_are_grouped_in_parts_that_grow_with_the_input(spark, tmp_path, monkeypatch):
    """What a task groups does not depend on how far the shuffle compresses."""
    from hrlens.operators import joins

    n = 20_000
    twice = spark.range(n).unionByName(spark.range(n)).withColumn("year", F.lit("2024"))
    extra = spark.createDataFrame([(None, "2024"), (None, "2024"), (n, "2024")], "id long, year string")
    twice.unionByName(extra).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(joins, "PART_BYTES", joins.input_bytes(df) // 40)
    found = V.key_unique(df, "t", ["id"])
    assert {(r.row_key, r.detail) for r in found.collect()} == {(str(k), "rows=2") for k in range(n)} | {("NULL", "rows=2")}
    assert found.select(F.spark_partition_id()).distinct().count() >= 40
    constant = df.select("id", F.lit("x").alias("period"))
    assert P.duplicate_rows(constant, "t").first()[1:] == (2 * n + 3, n + 1)
    plan = P.duplicate_rows(constant, "t")._jdf.queryExecution().executedPlan().toString()
    # One shuffle of the rows, and the one of the totals.
    assert plan.count("Exchange hashpartitioning") == 1


def test_goals_of_large_tables_are_joined_in_parts_that_grow_with_the_input(spark, sf001, monkeypatch):
    from hrlens.operators import joins
    from hrlens.sources import derive

    usual = derive.goals_view(spark, sf001)
    monkeypatch.setattr(derive, "LARGE_BYTES", 0, raising=False)
    monkeypatch.setattr(joins, "PART_BYTES", 4_000)
    large = derive.goals_view(spark, sf001)
    assert large.count() == usual.count() and large.exceptAll(usual).count() == 0
    assert large.select(F.spark_partition_id()).distinct().count() > 20
