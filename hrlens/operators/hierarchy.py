"""Reporting-line operators over the employees.manager_id self reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.operators.windows import global_rank

ACTIVE = "Active"


def resolve_manager(emp: DataFrame, depts: DataFrame) -> DataFrame:
    """Active employees with their manager's name, gender, department and
    level.

    The manager side is projected to six columns before the self join; the
    join is a left join on manager_id (a manager with a huge team is one
    skewed key on the left side only, which AQE splits). Employees whose
    manager exists but is not Active drop out; those without a manager
    (NULL or dangling manager_id) stay with NULL manager columns."""
    e = emp.where(F.col("status") == ACTIVE).select(
        "employee_id", "full_name", "gender", "dept_id", "job_level",
        F.col("manager_id").alias("_mgr_ref"),
    )
    m = emp.select(
        F.col("employee_id").alias("manager_id"),
        F.col("full_name").alias("manager_name"),
        F.col("gender").alias("manager_gender"),
        F.col("dept_id").alias("_m_dept"),
        F.col("job_level").alias("manager_level"),
        F.col("status").alias("_m_status"),
    )
    d = depts.select("dept_id", "dept_name")
    md = d.select(F.col("dept_id").alias("_md_id"), F.col("dept_name").alias("manager_department"))
    joined = (
        e.join(m, F.col("_mgr_ref") == F.col("manager_id"), "left")
        .where((F.col("_m_status") == ACTIVE) | F.col("manager_id").isNull())
        .join(d, "dept_id", "inner")
        .join(md, F.col("_m_dept") == F.col("_md_id"), "left")
    )
    return joined.select(
        "employee_id", "full_name", "gender", "dept_name", "job_level",
        "manager_id", "manager_name", "manager_gender", "manager_department",
        "manager_level",
    )


def direct_report_counts(emp: DataFrame, depts: DataFrame) -> DataFrame:
    """Active employees (as managers) with their number of Active direct
    reports (0 kept) and a rank by that number.

    Reports are counted per manager_id first, so the self join moves one row
    per manager, not one per report; the rank avoids a single-partition
    window (see ``global_rank``)."""
    reports = (
        emp.where((F.col("status") == ACTIVE) & F.col("manager_id").isNotNull())
        .groupBy("manager_id")
        .agg(F.count("employee_id").alias("_reports"))
    )
    d = depts.select("dept_id", "dept_name")
    managers = (
        emp.where(F.col("status") == ACTIVE)
        .select("employee_id", "full_name", "dept_id")
        .join(d, "dept_id", "inner")
    )
    # Join first, then group: the group-by keys start with the join key, so
    # the join's partitioning on employee_id serves the aggregation too (no
    # second shuffle). GROUP BY (employee_id, full_name, dept_name) keeps bag
    # semantics: an id listed twice is one group counting every report once
    # per copy, as the SQL join would.
    counted = (
        managers.join(reports, F.col("employee_id") == F.col("manager_id"), "left")
        .groupBy("employee_id", "full_name", "dept_name")
        .agg(F.sum(F.coalesce(F.col("_reports"), F.lit(0))).cast("bigint").alias("total_subordinates"))
        .select("full_name", "dept_name", "total_subordinates")
    )
    # The report counts sum to at most the number of (manager, report) pairs
    # (one per Active employee when ids are unique), so they take fewer than
    # sqrt(2 * pairs) + 2 distinct values: the rank table is provably small.
    return global_rank(counted, "total_subordinates", "rank_by_subordinates")
