"""The eighteen named workforce analyses.

Each takes an ``HRTables`` (clean five-table schema) and returns an unsorted
DataFrame; ``ORDER`` holds each analysis's presentation order, applied only
at the edge (``ordered``) so composing analyses never costs a global sort.

Population filters differ per analysis on purpose: headcount and hierarchy
look at Active staff, attrition at everyone, the pay gap at everyone with a
known gender.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.functions.numeric import avg_rounded, half_up_ratio
from hrlens.operators.aggregates import (
    mean_of_micro,
    mean_sd_band,
    two_group_gap,
    weighted_mean_micro,
)
from hrlens.operators.hierarchy import direct_report_counts, resolve_manager
from hrlens.operators.joins import exists_in, join_dimension
from hrlens.operators.rates import rate_aggs, tenure_bucket, with_tenure
from hrlens.operators.ordered import Pieces, previous_value, top_n_with_ties
from hrlens.operators.windows import change_from_previous, date_split, vs_group_mean
from hrlens.schemas import (
    AT_OR_ABOVE_BAND,
    BAND_UNIT,
    BELOW_BAND,
    HIGHER_FEMALE,
    HIGHER_MALE,
    SNAPSHOT,
)
from hrlens.sources.derive import HRTables


def ACTIVE():  # noqa: N802 - reads like the predicate it builds
    return F.col("status") == "Active"


def RESIGNED():  # noqa: N802
    return F.col("status") == "Resigned"


def _depts(t: HRTables) -> DataFrame:
    return t.departments.select("dept_id", "dept_name", "salary_band_mid")


def _with_dept(df: DataFrame, t: HRTables, how: str = "inner") -> DataFrame:
    return join_dimension(df, _depts(t), "dept_id", how)


# --------------------------------------------------------------------------- #
# Headcount and distribution
# --------------------------------------------------------------------------- #
def headcount_by_department(t: HRTables) -> DataFrame:
    """Active headcount per department name. Plan: scan -> broadcast
    department join -> partial/final count (one shuffle of partial counts)."""
    emp = t.employees.where(ACTIVE()).select("employee_id", "dept_id")
    return (
        _with_dept(emp, t)
        .groupBy("dept_name")
        .agg(F.count("employee_id").alias("total_employee"))
    )


def avg_salary_by_level(t: HRTables) -> DataFrame:
    """round(avg(salary)) of Active staff per job level (NULL salaries
    skipped)."""
    return (
        t.employees.where(ACTIVE())
        .groupBy("job_level")
        .agg(avg_rounded(F.col("monthly_salary_idr"), 0, input_digits=0).alias("average_salary"))
    )


def headcount_by_city_type(t: HRTables) -> DataFrame:
    """Active headcount per (city, employment type)."""
    return (
        t.employees.where(ACTIVE())
        .groupBy("city", "employment_type")
        .agg(F.count("employee_id").alias("total_employee"))
    )


def headcount_by_type_city(t: HRTables) -> DataFrame:
    """Active headcount per (employment type, city); ordered differently."""
    return (
        t.employees.where(ACTIVE())
        .groupBy("employment_type", "city")
        .agg(F.count("employee_id").alias("total_employee"))
    )


# --------------------------------------------------------------------------- #
# Attrition
# --------------------------------------------------------------------------- #
def attrition_overall(t: HRTables) -> DataFrame:
    """Everyone: headcount, resigned, attrition rate (one row; NULL rate on
    an empty table instead of a division error)."""
    return t.employees.agg(*rate_aggs(RESIGNED()))


def attrition_by_department(t: HRTables) -> DataFrame:
    """Attrition per department (everyone, inner join drops unknown
    departments)."""
    return _with_dept(t.employees, t).groupBy("dept_name").agg(*rate_aggs(RESIGNED()))


def attrition_vs_satisfaction(t: HRTables) -> DataFrame:
    """Attrition per department beside the mean satisfaction (NULL scores
    skipped, never filled)."""
    return (
        _with_dept(t.employees, t)
        .groupBy("dept_name")
        .agg(
            *rate_aggs(RESIGNED()),
            avg_rounded(F.col("satisfaction_score"), 2).alias(
                "avg_satisfaction"
            ),
        )
    )


def attrition_by_tenure(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """Attrition and satisfaction per (department, tenure bucket); tenure is
    completed years from hire to termination or the snapshot, and an unknown
    tenure falls into the last bucket."""
    emp = with_tenure(t.employees, snapshot)
    return (
        _with_dept(emp, t)
        .withColumn("tenure_bucket", tenure_bucket(F.col("tenure_years")))
        .groupBy("dept_name", "tenure_bucket")
        .agg(
            *rate_aggs(RESIGNED()),
            avg_rounded(F.col("satisfaction_score"), 2).alias(
                "avg_satisfaction"
            ),
        )
    )


def _first_year(t: HRTables, snapshot: _dt.date) -> DataFrame:
    return with_tenure(t.employees, snapshot).where(F.col("tenure_years") < 1)


def first_year_attrition_by_band(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """First-year attrition (tenure < 1 completed year) by salary against
    the department band midpoint; an unknown salary counts as at/above."""
    below = F.col("monthly_salary_idr") < F.col("salary_band_mid") * BAND_UNIT
    return (
        _with_dept(_first_year(t, snapshot), t)
        .withColumn(
            "salary_position", F.when(below, BELOW_BAND).otherwise(AT_OR_ABOVE_BAND)
        )
        .groupBy("salary_position")
        .agg(*rate_aggs(RESIGNED()))
    )


def first_year_attrition_by_type(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """First-year attrition per employment type, among employees whose
    department exists."""
    # The department join only filters (no department column is used).
    return (
        exists_in(_first_year(t, snapshot), t.departments, "dept_id")
        .groupBy("employment_type")
        .agg(*rate_aggs(RESIGNED()))
    )


# --------------------------------------------------------------------------- #
# Performance and pay
# --------------------------------------------------------------------------- #
def review_trend(t: HRTables) -> DataFrame:
    """Per review period: mean score, sample stddev, and mean -/+ stddev
    (bounds from the unrounded values)."""
    return (
        t.performance_reviews.groupBy("review_period")
        .agg(*mean_sd_band(F.col("review_score"), 2))
        .select(
            "review_period",
            F.col("avg").alias("avg_review_score"),
            F.col("sd").alias("score_stddev"),
            F.col("lo").alias("bottom_limit"),
            F.col("hi").alias("upper_limit"),
        )
    )


def goal_achievement_by_department(t: HRTables) -> DataFrame:
    """Mean over employees of each employee's weight-averaged goal
    achievement, per department (not pooled over goals)."""
    # Goals are reduced to one row per employee before meeting the employee
    # table (inner join: employees without goals drop out).
    per_emp = weighted_mean_micro(
        t.goals, ["employee_id"], "achievement_pct", "weight_pct", "overall_micro"
    )
    emp = t.employees.select("employee_id", "dept_id").join(per_emp, "employee_id")
    return (
        _with_dept(emp, t)
        .groupBy("dept_name")
        .agg(mean_of_micro(F.col("overall_micro"), 2).alias("avg_achievement"))
    )


def gender_pay_gap_by_level(t: HRTables) -> DataFrame:
    """Male vs female mean salary per level (everyone with a known gender),
    the gap, and the gap as a share of the higher mean."""
    return two_group_gap(
        t.employees,
        ["job_level"],
        "gender",
        "Male",
        "Female",
        "monthly_salary_idr",
        "avg_male",
        "avg_female",
        HIGHER_MALE,
        HIGHER_FEMALE,
    )


# --------------------------------------------------------------------------- #
# Window analyses
# --------------------------------------------------------------------------- #
def top3_salary_by_department(t: HRTables, n: int = 3) -> DataFrame:
    """rank() <= n of salary within each department, ties kept; a NULL salary
    ranks first (descending NULLS FIRST). The ranks are found on (department,
    salary) counts, so any number of ties spreads over tasks."""
    emp = t.employees.select("full_name", "dept_id", "monthly_salary_idr")
    ranked = top_n_with_ties(emp, ["dept_id"], "monthly_salary_idr", n, "salary_rank")
    return _with_dept(ranked, t).select("dept_name", "salary_rank", "full_name", "monthly_salary_idr")


def salary_vs_peer_average(t: HRTables) -> DataFrame:
    """Each employee against the rounded mean of their (department, level):
    the mean is an aggregate joined back,
    not a window over the whole group."""
    emp = t.employees.select("full_name", "dept_id", "job_level", "monthly_salary_idr")
    with_mean = vs_group_mean(
        emp, ["dept_id", "job_level"], "monthly_salary_idr", "_avg"
    )
    gap = F.col("monthly_salary_idr") - F.col("_avg")
    return _with_dept(with_mean, t).select(
        "dept_name",
        "job_level",
        "full_name",
        "monthly_salary_idr",
        F.col("_avg").cast("double").alias("avg_dept_salary"),
        gap.cast("double").alias("pay_gap"),
        half_up_ratio(gap * 100, F.col("_avg"), 2).alias("pay_gap_pct"),
    )


def _previous_salary(sal: DataFrame, out: str, split: str | None, pieces: Pieces) -> DataFrame:
    order, value = ["effective_date", "salary_id"], "monthly_salary_idr"
    if split is None:
        return previous_value(sal, "employee_id", order, value, out, pieces)
    return change_from_previous(sal, "employee_id", order, value, out, split=date_split(F.col("effective_date"), split))


def salary_changes(t: HRTables, split: str | None = None, pieces: Pieces = Pieces()) -> DataFrame:
    """Every salary row with the previous salary of the same employee (ordered
    by date, then salary id) and the change. An employee with more than
    ``pieces.hot_rows`` rows is cut into pieces at quantiles of the history;
    ``split="year"`` or ``"month"`` cuts every history by the calendar."""
    sal = t.salaries.select("salary_id", "employee_id", "effective_date", "monthly_salary_idr", "change_reason")
    with_prev = _previous_salary(sal, "prev_salary", split, pieces)
    emp = t.employees.select("employee_id", "full_name")
    return with_prev.join(emp, "employee_id").select(
        "full_name",
        "effective_date",
        F.col("monthly_salary_idr").alias("current_salary"),
        "prev_salary",
        (F.col("monthly_salary_idr") - F.col("prev_salary")).alias("salary_change"),
        "change_reason",
    )


# --------------------------------------------------------------------------- #
# Hierarchy
# --------------------------------------------------------------------------- #
def org_structure(t: HRTables) -> DataFrame:
    """Active employees with their manager's details; see
    ``operators.hierarchy.resolve_manager``."""
    return resolve_manager(t.employees, t.departments)


def subordinate_counts(t: HRTables) -> DataFrame:
    """Active employees with their Active direct-report count and rank; see
    ``operators.hierarchy.direct_report_counts``."""
    return direct_report_counts(t.employees, t.departments)


# name -> (function, presentation order as (column, "asc" | "desc"));
# ascending puts NULLs last and descending puts them first, as PostgreSQL.
ANALYSES = {
    "headcount_by_department": (headcount_by_department, [("total_employee", "desc")]),
    "avg_salary_by_level": (avg_salary_by_level, [("average_salary", "desc")]),
    "headcount_by_city_type": (headcount_by_city_type, [("city", "asc"), ("employment_type", "asc")]),
    "headcount_by_type_city": (headcount_by_type_city, [("employment_type", "asc"), ("total_employee", "desc")]),
    "attrition_overall": (attrition_overall, []),
    "attrition_by_department": (attrition_by_department, [("attrition_rate", "desc")]),
    "attrition_vs_satisfaction": (attrition_vs_satisfaction, [("attrition_rate", "desc")]),
    "attrition_by_tenure": (attrition_by_tenure, [("attrition_rate", "desc")]),
    "first_year_attrition_by_band": (first_year_attrition_by_band, []),
    "first_year_attrition_by_type": (first_year_attrition_by_type, []),
    "review_trend": (review_trend, [("review_period", "asc")]),
    "goal_achievement_by_department": (goal_achievement_by_department, [("avg_achievement", "desc")]),
    "gender_pay_gap_by_level": (gender_pay_gap_by_level, [("abs(pay_gap)", "desc")]),
    "top3_salary_by_department": (top3_salary_by_department, [("dept_name", "asc"), ("salary_rank", "asc")]),
    "salary_vs_peer_average": (salary_vs_peer_average, [("dept_name", "asc"), ("job_level", "asc"), ("pay_gap", "desc")]),
    "salary_changes": (salary_changes, [("full_name", "asc"), ("effective_date", "asc")]),
    "org_structure": (org_structure, [("full_name", "asc")]),
    "subordinate_counts": (subordinate_counts, [("rank_by_subordinates", "asc")]),
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    """Apply an analysis's presentation order (PostgreSQL NULL placement)."""
    order = [
        F.expr(c).asc_nulls_last() if d == "asc" else F.expr(c).desc_nulls_first()
        for c, d in ANALYSES[name][1]
    ]
    return df.orderBy(*order) if order else df
