"""Registered queries over ordered pieces, reporting lines, calendars as
tables, CSV exports with line breaks, planted faults and date evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrlens.operators import quality as V
from hrlens.operators.date_evidence import date_evidence
from hrlens.operators.intervals import containing, overlapping
from hrlens.operators.lines import reporting_lines
from hrlens.operators.ordered import rank_all
from hrlens.plans.cleaning_checks import raw_table
from hrlens.schemas import GENDER_DOMAIN
from hrlens.session import scratch_path
from hrlens.sources.derive import HRTables
from hrlens.sources.raw import read_csv
from hrlens.sources.sinks import write_csv

#: The calendar tables' first day and number of periods.
CALENDAR_START, PERIODS, PERIOD_DAYS = "2012-01-01", 1000, 5
SNAPSHOT = "2025-06-30"


def faulty(t: HRTables) -> DataFrame:
    """The employees view with faults of every checked kind at fixed ids."""
    k = F.col("employee_id")
    e = t.employees.select(
        "employee_id",
        F.when(k % 40 == 1, 1000 + k % 7).otherwise(F.col("dept_id")).alias("dept_id"),
        F.when(k % 30 == 3, "X").when(k % 30 != 4, F.col("gender")).alias("gender"),
        F.when(k % 45 == 5, -F.col("monthly_salary_idr")).when(k % 45 == 6, 0).otherwise(F.col("monthly_salary_idr")).alias("monthly_salary_idr"),
        F.when(k % 35 == 2, 10_000_000 + k % 11).otherwise(F.col("manager_id")).alias("manager_id"),
    )
    copies = F.when(k % 100 == 0, 3).when(k % 50 == 0, 2).otherwise(1)
    return e.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_i")).drop("_i")


def v01_planted_keys(t: HRTables) -> DataFrame:
    return V.key_unique(faulty(t), "employees", ["employee_id"])


def v02_planted_departments(t: HRTables) -> DataFrame:
    return V.foreign_key(faulty(t), "employees", "dept_id", t.departments, "departments", "dept_id")


def v03_planted_managers(t: HRTables) -> DataFrame:
    return V.foreign_key(faulty(t), "employees", "manager_id", t.employees, "employees", "employee_id")


def v04_planted_genders(t: HRTables) -> DataFrame:
    return V.in_domain(faulty(t), "employees", "employee_id", "gender", GENDER_DOMAIN)


def v05_planted_salaries(t: HRTables) -> DataFrame:
    return V.positive(faulty(t), "employees", "employee_id", "monthly_salary_idr")


def w05_salary_rank(t: HRTables) -> DataFrame:
    """Rank of every salary of the history among all."""
    sal = t.salaries.select("salary_id", "employee_id", "monthly_salary_idr")
    return rank_all(sal, "monthly_salary_idr", "salary_rank")


def tangled(t: HRTables) -> DataFrame:
    """Managers with pairs that report to each other, and chains of thirty."""
    k = F.col("employee_id")
    r = k % 100
    manager = F.when(r == 50, k + 1).when(r == 51, k - 1).when((r >= 60) & (r < 90), k + 1).otherwise(F.col("manager_id"))
    return t.employees.select("employee_id", manager.alias("manager_id"))


def r4_reporting_lines(t: HRTables) -> DataFrame:
    return reporting_lines(tangled(t))


def calendar(t: HRTables) -> DataFrame:
    day = F.date_add(F.lit(CALENDAR_START).cast("date"), (F.col("id") * PERIOD_DAYS).cast("int"))
    periods = t.employees.sparkSession.range(PERIODS).select(F.col("id").alias("period_no"), day.alias("period_start"))
    return periods.withColumn("period_end", F.date_add("period_start", PERIOD_DAYS - 1))


def _employed(t: HRTables) -> DataFrame:
    return t.employees.select("employee_id", "dept_id", "hire_date", F.coalesce("termination_date", F.lit(SNAPSHOT).cast("date")).alias("left_date"))


def j10_headcount_by_period(t: HRTables) -> DataFrame:
    """Employees on the books in each of a thousand periods."""
    pairs = overlapping(calendar(t), "period_start", "period_end", _employed(t), "hire_date", "left_date", bin_days=365)
    return pairs.groupBy("period_no", "period_start").agg(F.count(F.lit(1)).alias("employees"), F.countDistinct("dept_id").alias("departments"))


def r3_reviews_due(t: HRTables) -> DataFrame:
    """Review periods that close within each employee's tenure, from a
    calendar table: their number, the first and the last."""
    ends = calendar(t).select("period_no", "period_end")
    due = containing(_employed(t), "hire_date", "left_date", ends, "period_end", bin_days=365)
    return due.groupBy("employee_id").agg(F.count(F.lit(1)).alias("due"), F.min("period_no").alias("first_period"), F.max("period_no").alias("last_period"))


EXPORT = T.StructType([T.StructField(c, T.StringType()) for c in ("employee_id", "full_name", "city")])


def s1_csv_round_trip(t: HRTables) -> DataFrame:
    """Employees exported as CSV, with line breaks, quotes and commas inside
    fields, and read back: files with line breaks whole, the others split."""
    k = F.col("employee_id")
    name = F.when(k % 10 == 0, F.concat("full_name", F.lit('\nsecond "line"'))).when(k % 10 == 1, F.concat("full_name", F.lit(', "J,r"')))
    out = t.employees.select(
        F.col("employee_id").cast("string").alias("employee_id"),
        F.coalesce(name, F.col("full_name")).alias("full_name"),
        F.when(k % 13 != 0, F.concat(F.lit(" "), F.col("city"))).alias("city"),
        (k % 10 == 0).alias("_b"),
    )
    spark = t.employees.sparkSession
    path = write_csv(out.repartition(8, "_b").drop("_b"), scratch_path(spark, f"export-{uuid.uuid4().hex}"))
    return read_csv(spark, path, EXPORT)


def c05_date_evidence(t: HRTables) -> DataFrame:
    """Formats of the raw date columns, and of one whose slash dates are
    month-first but for a few."""
    emp = raw_table(t, "employees")
    k = F.length("full_name") + F.length("city")
    us = F.when(k % 9 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    swapped = t.employees.select(F.col("hire_date").alias("d"), "full_name", "city").withColumn("us_date", us)
    first = date_evidence(emp, ["hire_date", "termination_date"])
    return first.unionByName(date_evidence(swapped, ["us_date"]))


STRUCTURE_QUERIES = {
    "v01_planted_keys": v01_planted_keys,
    "v02_planted_departments": v02_planted_departments,
    "v03_planted_managers": v03_planted_managers,
    "v04_planted_genders": v04_planted_genders,
    "v05_planted_salaries": v05_planted_salaries,
    "w05_salary_rank": w05_salary_rank,
    "r4_reporting_lines": r4_reporting_lines,
    "j10_headcount_by_period": j10_headcount_by_period,
    "r3_reviews_due": r3_reviews_due,
    "s1_csv_round_trip": s1_csv_round_trip,
    "c05_date_evidence": c05_date_evidence,
}
