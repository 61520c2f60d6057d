"""Rules of the source project's data simulator, re-aimed at existing tables:
pay against the level band, the attrition risk model, expected review
coverage, reporting-line rules and salary-history consistency."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.functions.dates import fractional_years
from hrlens.functions.numeric import DEC, UNITS, exact_units, half_up_int, half_up_ratio, pct
from hrlens.operators.rates import rate_aggs
from hrlens.operators.ordered import Pieces
from hrlens.plans.analyses import RESIGNED, _previous_salary, _with_dept
from hrlens.plans.extensions import level_rank
from hrlens.schemas import (
    LEVEL_MULTIPLIER,
    LEVELS,
    REVIEW_PERIODS,
    RISK_BASE,
    RISK_INTERN_BUMP,
    RISK_LOW_PERF,
    RISK_LOW_PERF_BUMP,
    RISK_MAX,
    RISK_MIN,
    RISK_PAY_WEIGHT,
    RISK_SAT_PIVOT,
    RISK_SAT_WEIGHT,
    RISK_SHORT_TENURE_BUMP,
    RISK_SHORT_TENURE_YEARS,
    SNAPSHOT,
)
from hrlens.sources.derive import HRTables

M = 100_000_000  # risk scores are exact integers in 1e-8 units


def multiplier_pct(level) -> F.Column:
    """Level salary multiplier in hundredths (Mid = 100); unknown -> NULL."""
    pairs = []
    for name in LEVELS:
        pairs += [F.lit(name), F.lit(round(LEVEL_MULTIPLIER[name] * 100))]
    return F.try_element_at(F.create_map(*pairs), level).cast("bigint")


def expected_salary(band_mid, level) -> F.Column:
    """Band midpoint (millions) x level multiplier, to whole IDR."""
    return half_up_int(exact_units(band_mid) * multiplier_pct(level), F.lit(100))


def pay_vs_level_band(t: HRTables) -> DataFrame:
    """Each employee's salary against band midpoint x level multiplier (ratio
    to 4 places)."""
    emp = _with_dept(
        t.employees.select("employee_id", "dept_id", "job_level", "monthly_salary_idr"), t
    )
    exp = expected_salary(F.col("salary_band_mid"), F.col("job_level"))
    return emp.select(
        "employee_id",
        "dept_name",
        "job_level",
        "monthly_salary_idr",
        exp.alias("expected_salary"),
        half_up_ratio(F.col("monthly_salary_idr"), exp, 4).alias("pay_ratio"),
    )


def _units(x: float) -> int:
    return round(x * M)


def risk_score(snapshot: _dt.date = SNAPSHOT) -> F.Column:
    """The attrition risk model as an exact integer (1e-8 units), over
    employee rows joined to their department band:

    0.16 + (3.5 - satisfaction) x 0.08 + (base - salary) / base x 0.30
    [+0.08 if tenure < 1.5 y] [+0.10 if performance < 2.8] [+0.06 if Intern],
    clipped to [0.03, 0.80]. A missing satisfaction or salary drops its term.
    """
    sat = exact_units(F.col("satisfaction_score"))
    sat_term = (F.lit(round(RISK_SAT_PIVOT * 10**UNITS)) - sat) * (_units(RISK_SAT_WEIGHT) // 10**UNITS)
    base = expected_salary(F.col("salary_band_mid"), F.col("job_level"))
    pay_term = half_up_int((base - F.col("monthly_salary_idr")).cast(DEC) * _units(RISK_PAY_WEIGHT), base, 0)
    tenure = fractional_years(F.col("hire_date"), F.lit(snapshot))
    total = (
        F.lit(_units(RISK_BASE))
        + F.coalesce(sat_term, F.lit(0))
        + F.coalesce(pay_term, F.lit(0))
        + F.when(tenure < RISK_SHORT_TENURE_YEARS, _units(RISK_SHORT_TENURE_BUMP)).otherwise(0)
        + F.when(F.col("last_performance_score") < RISK_LOW_PERF, _units(RISK_LOW_PERF_BUMP)).otherwise(0)
        + F.when(F.col("job_level") == "Intern", _units(RISK_INTERN_BUMP)).otherwise(0)
    )
    return F.greatest(F.lit(_units(RISK_MIN)), F.least(F.lit(_units(RISK_MAX)), total)).cast("bigint")


def attrition_risk_score(t: HRTables, snapshot: _dt.date = SNAPSHOT) -> DataFrame:
    """Expected attrition (mean risk score) against observed, per department."""
    emp = _with_dept(t.employees, t).withColumn("_risk", risk_score(snapshot))
    return emp.groupBy("dept_name").agg(
        F.count(F.lit(1)).alias("headcount"),
        half_up_ratio(F.sum("_risk").cast("decimal(38,0)") * 100, F.count(F.lit(1)) * M, 2).alias(
            "expected_attrition_pct"
        ),
        *rate_aggs(RESIGNED())[1:],
    )


def expected_reviews(
    t: HRTables,
    calendar: list[tuple[str, _dt.date]] = REVIEW_PERIODS,
    snapshot: _dt.date = SNAPSHOT,
) -> DataFrame:
    """(employee_id, review_period) for every period whose closing date falls
    within the employee's tenure. The calendar is a literal array filtered
    per row (no join)."""
    periods = F.array(
        *[F.struct(F.lit(p).alias("review_period"), F.lit(d).alias("period_end")) for p, d in calendar]
    )
    end = F.coalesce(F.col("termination_date"), F.lit(snapshot))
    hire = F.col("hire_date")
    due = F.filter(periods, lambda p: (hire <= p["period_end"]) & (p["period_end"] <= end))
    return t.employees.select("employee_id", F.explode(due).alias("_p")).select(
        "employee_id", F.col("_p.review_period").alias("review_period")
    )


def _coverage(t: HRTables, calendar, snapshot) -> DataFrame:
    expected = expected_reviews(t, calendar, snapshot)
    present = (
        t.performance_reviews.groupBy("employee_id", "review_period")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    return expected.join(present, ["employee_id", "review_period"], "left")


def review_coverage(
    t: HRTables,
    calendar: list[tuple[str, _dt.date]] = REVIEW_PERIODS,
    snapshot: _dt.date = SNAPSHOT,
) -> DataFrame:
    """Per review period: expected reviews (periods closing within tenure),
    present, missing and the coverage percentage."""
    covered = F.col("reviews").isNotNull()
    return (
        _coverage(t, calendar, snapshot)
        .groupBy("review_period")
        .agg(
            F.count(F.lit(1)).alias("expected_reviews"),
            F.count_if(covered).alias("present_reviews"),
            F.count_if(~covered).alias("missing_reviews"),
            pct(F.count_if(covered), F.count(F.lit(1))).alias("coverage_pct"),
        )
    )


def missing_reviews(
    t: HRTables,
    calendar: list[tuple[str, _dt.date]] = REVIEW_PERIODS,
    snapshot: _dt.date = SNAPSHOT,
) -> DataFrame:
    """The (employee, period) pairs that should have a review but have none."""
    return (
        _coverage(t, calendar, snapshot)
        .where(F.col("reviews").isNull())
        .select("employee_id", "review_period")
    )


def manager_rule_violations(t: HRTables) -> DataFrame:
    """Reporting lines that break the rule "a manager is in the same
    department and strictly more senior". Checked with an equi-join on the
    manager id, never by pairing employees."""
    e = t.employees.where(F.col("manager_id").isNotNull()).select(
        "employee_id",
        "manager_id",
        F.col("dept_id").alias("employee_dept_id"),
        F.col("job_level").alias("employee_level"),
    )
    m = t.employees.select(
        F.col("employee_id").alias("_mid"),
        F.col("dept_id").alias("manager_dept_id"),
        F.col("job_level").alias("manager_level"),
    )
    j = e.join(m, F.col("manager_id") == F.col("_mid"), "inner")
    same = F.coalesce(F.col("employee_dept_id") == F.col("manager_dept_id"), F.lit(False))
    above = F.coalesce(
        level_rank(F.col("manager_level")) > level_rank(F.col("employee_level")), F.lit(False)
    )
    return j.select(
        "employee_id",
        "manager_id",
        "employee_dept_id",
        "manager_dept_id",
        "employee_level",
        "manager_level",
        same.alias("same_department"),
        above.alias("manager_outranks"),
    ).where(~F.col("same_department") | ~F.col("manager_outranks"))


def salary_history_checks(t: HRTables, initial_reason: str = "Initial", split: str | None = None, pieces: Pieces = Pieces()) -> DataFrame:
    """Per employee with history: rows, last salary vs current salary, first
    row's reason, and the number of pay decreases along the history."""
    sal = t.salaries.select("salary_id", "employee_id", "effective_date", "monthly_salary_idr", "change_reason")
    hist = _previous_salary(sal, "_prev", split, pieces)
    key = F.struct(
        F.struct(F.col("effective_date").isNull(), F.col("effective_date")),
        F.struct(F.col("salary_id").isNull(), F.col("salary_id")),
    )
    per_emp = hist.groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("history_rows"),
        F.max_by("monthly_salary_idr", key).alias("last_salary"),
        F.min_by("change_reason", key).alias("_first_reason"),
        F.count_if(F.col("monthly_salary_idr") < F.col("_prev")).alias("decreases"),
    )
    emp = t.employees.select("employee_id", F.col("monthly_salary_idr").alias("current_salary"))
    return per_emp.join(emp, "employee_id").select(
        "employee_id",
        "history_rows",
        "last_salary",
        "current_salary",
        F.coalesce(F.col("last_salary") == F.col("current_salary"), F.lit(False)).alias(
            "last_matches_current"
        ),
        F.coalesce(F.col("_first_reason") == initial_reason, F.lit(False)).alias("first_is_initial"),
        "decreases",
    )


def _derived_calendar(fn):
    from hrlens.sources.derive import DERIVED_REVIEW_CALENDAR

    def run(t: HRTables) -> DataFrame:
        return fn(t, DERIVED_REVIEW_CALENDAR)

    run.__name__ = fn.__name__
    return run


RULE_QUERIES = {
    "r1_pay_vs_level_band": pay_vs_level_band,
    "r2_attrition_risk_score": attrition_risk_score,
    "r3_review_coverage": _derived_calendar(review_coverage),
    "r3_missing_reviews": _derived_calendar(missing_reviews),
    "r4_manager_rule_violations": manager_rule_violations,
    "r6_salary_history_checks": salary_history_checks,
}
