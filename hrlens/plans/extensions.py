"""Analyses the source project quotes figures for or asks about, without a
query of its own (shares, level steps, drill-downs, correlations)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrlens.functions.numeric import DEC, UNITS, as_int, exact_units, half_up_int, half_up_ratio, pct
from hrlens.operators.aggregates import MICRO, mean_of_micro, two_group_gap, weighted_mean_micro
from hrlens.operators.rates import rate_aggs, tenure_bucket, with_tenure
from hrlens.plans.analyses import (
    RESIGNED,
    _with_dept,
    avg_salary_by_level,
    goal_achievement_by_department,
    headcount_by_city_type,
    headcount_by_department,
)
from hrlens.schemas import HIGHER_FEMALE, HIGHER_MALE, LEVELS, SNAPSHOT
from hrlens.sources.derive import HRTables


# Windows below run over already-aggregated tables whose size is bounded by a
# dimension (departments, cities x types, levels), never over raw rows.
def _whole() -> Window:
    return Window.partitionBy()


def level_rank(c) -> F.Column:
    """Ordinal of a job level (Intern = 0 ... Head = 6); unknown -> NULL."""
    pairs = []
    for i, name in enumerate(LEVELS):
        pairs += [F.lit(name), F.lit(i)]
    return F.try_element_at(F.create_map(*pairs), c).cast("bigint")


def headcount_share(t: HRTables) -> DataFrame:
    """Each department's share of Active staff and the share of the two
    largest departments together."""
    counts = headcount_by_department(t)
    total = F.sum("total_employee").over(_whole())
    order = Window.orderBy(F.desc_nulls_first("total_employee"), F.asc_nulls_last("dept_name"))
    top2 = F.sum(F.when(F.col("_pos") <= 2, F.col("total_employee"))).over(_whole())
    return counts.withColumn("_pos", F.row_number().over(order)).select(
        "dept_name",
        "total_employee",
        pct(F.col("total_employee"), total).alias("share_pct"),
        pct(top2, total).alias("top2_share_pct"),
    )


def employment_type_share_by_city(t: HRTables) -> DataFrame:
    """Each employment type's share of a city's Active staff (window over the
    city x type aggregate)."""
    counts = headcount_by_city_type(t)
    city_total = F.sum("total_employee").over(Window.partitionBy("city"))
    return counts.select(
        "city",
        "employment_type",
        "total_employee",
        pct(F.col("total_employee"), city_total).alias("share_pct"),
    )


def salary_step_between_levels(t: HRTables) -> DataFrame:
    """Average salary per level, the step from the level below, and the
    spread between the best- and worst-paid level."""
    avg = avg_salary_by_level(t).withColumn("level_rank", level_rank(F.col("job_level")))
    cur = F.col("average_salary").cast("bigint")
    prev = F.lag(cur).over(Window.orderBy(F.asc_nulls_last("level_rank")))
    return avg.select(
        "job_level",
        "level_rank",
        "average_salary",
        prev.cast("double").alias("prev_level_salary"),
        half_up_ratio((cur - prev) * 100, prev, 2).alias("step_pct"),
        half_up_ratio(F.max(cur).over(_whole()), F.min(cur).over(_whole()), 2).alias("spread_ratio"),
    )


def attrition_by_tenure_overall(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """Attrition per tenure bucket over all departments."""
    return (
        with_tenure(t.employees, snapshot)
        .withColumn("tenure_bucket", tenure_bucket(F.col("tenure_years")))
        .groupBy("tenure_bucket")
        .agg(*rate_aggs(RESIGNED()))
    )


def attrition_by_level(t: HRTables) -> DataFrame:
    """Attrition per job level."""
    return t.employees.groupBy("job_level").agg(*rate_aggs(RESIGNED()))


def first_year_attrition_by_department(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """First-year attrition (tenure < 1 completed year) per department."""
    first = with_tenure(t.employees, snapshot).where(F.col("tenure_years") < 1)
    return _with_dept(first, t).groupBy("dept_name").agg(*rate_aggs(RESIGNED()))


def goal_vs_review_by_department(t: HRTables, digits: int = 4) -> DataFrame:
    """Per department: employees with both goals and reviews, their mean goal
    achievement, mean review score, and the Pearson correlation of the two
    per-employee figures (computed from exact integer sums)."""
    goals = weighted_mean_micro(t.goals, ["employee_id"], "achievement_pct", "weight_pct", "x")
    score = exact_units(F.col("review_score")).cast(DEC)
    reviews = t.performance_reviews.groupBy("employee_id").agg(
        half_up_int(F.sum(score), F.count(score) * 10**UNITS, MICRO).alias("y")
    ).where(F.col("y").isNotNull())
    per_emp = (
        t.employees.select("employee_id", "dept_id")
        .join(goals, "employee_id")
        .join(reviews, "employee_id")
    )
    x, y = F.col("x").cast(DEC), F.col("y").cast(DEC)
    n = F.count(F.lit(1)).cast(DEC)
    sxy = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    sxx = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    syy = n * F.sum(y * y) - F.sum(y) * F.sum(y)
    corr = F.when(
        (sxx > 0) & (syy > 0),
        sxy.cast("double") / F.sqrt(sxx.cast("double") * syy.cast("double")),
    )
    return (
        _with_dept(per_emp, t)
        .groupBy("dept_name")
        .agg(
            F.count(F.lit(1)).alias("employees"),
            mean_of_micro(F.col("x"), 2).alias("avg_achievement"),
            mean_of_micro(F.col("y"), 2).alias("avg_review_score"),
            F.round(corr, digits).alias("achievement_review_corr"),
        )
    )


def pay_gap_group_sizes(t: HRTables) -> DataFrame:
    """Group sizes behind the gender pay gap per level (small-sample check)."""
    g = F.col("gender")
    m = F.count_if(g == "Male")
    f = F.count_if(g == "Female")
    return (
        t.employees.where(g.isin("Male", "Female"))
        .groupBy("job_level")
        .agg(m.alias("male_employees"), f.alias("female_employees"), F.least(m, f).alias("smaller_group"))
    )


def pay_gap_by_department_level(t: HRTables) -> DataFrame:
    """The gender pay gap per (department, level): the gap with level held
    fixed."""
    emp = _with_dept(
        t.employees.select("dept_id", "job_level", "gender", "monthly_salary_idr"), t
    )
    return two_group_gap(
        emp,
        ["dept_name", "job_level"],
        "gender",
        "Male",
        "Female",
        "monthly_salary_idr",
        "avg_male",
        "avg_female",
        HIGHER_MALE,
        HIGHER_FEMALE,
    )


def spread_across_groups(t: HRTables) -> DataFrame:
    """max - min of the department goal-achievement averages."""
    per_dept = goal_achievement_by_department(t)
    hi, lo = F.max("avg_achievement"), F.min("avg_achievement")
    return per_dept.agg(
        F.lit("avg_achievement").alias("metric"),
        lo.alias("min_value"),
        hi.alias("max_value"),
        ((as_int(hi, 2) - as_int(lo, 2)) / 100.0).alias("spread"),
    )


EXTENSION_QUERIES = {
    "e01_headcount_share": headcount_share,
    "e02_employment_type_share_by_city": employment_type_share_by_city,
    "e03_salary_step_between_levels": salary_step_between_levels,
    "e04_attrition_by_tenure_overall": attrition_by_tenure_overall,
    "e04_attrition_by_level": attrition_by_level,
    "e05_first_year_attrition_by_department": first_year_attrition_by_department,
    "e06_goal_vs_review_by_department": goal_vs_review_by_department,
    "e07_pay_gap_group_sizes": pay_gap_group_sizes,
    "e08_pay_gap_by_department_level": pay_gap_by_department_level,
    "e09_spread_across_groups": spread_across_groups,
}
