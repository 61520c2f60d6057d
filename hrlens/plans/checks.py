"""Registered validation (V*) and profiling (P*) queries over the HR views
and over raw strings dirtied from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.functions.numeric import DEC, avg_rounded, half_up_ratio, pct
from hrlens.functions.parse import is_ambiguous_date, parse_date_multi
from hrlens.operators import profiling as P
from hrlens.operators import quality as V
from hrlens.operators.cleaning import clean_employees, drop_duplicate_rows
from hrlens.plans.cleaning_checks import raw_table
from hrlens.schemas import GENDER_DOMAIN
from hrlens.sources.derive import HRTables


def v01_key_unique(t: HRTables) -> DataFrame:
    return V.key_unique(t.employees, "employees", ["employee_id"])


def v02_dept_fk(t: HRTables) -> DataFrame:
    return V.foreign_key(t.employees, "employees", "dept_id", t.departments, "departments", "dept_id")


def v03_manager_fk(t: HRTables) -> DataFrame:
    return V.foreign_key(t.employees, "employees", "manager_id", t.employees, "employees", "employee_id")


def v04_gender_domain(t: HRTables) -> DataFrame:
    return V.in_domain(t.employees, "employees", "employee_id", "gender", GENDER_DOMAIN)


def v05_positive_salary(t: HRTables) -> DataFrame:
    return V.positive(t.employees, "employees", "employee_id", "monthly_salary_idr")


def v06_extended_checks(t: HRTables) -> DataFrame:
    return V.validate_extended(t)


def a13_sanity_stats(t: HRTables) -> DataFrame:
    """The simulator's closing sanity figures over the employees table:
    attrition share (mean of a boolean), mean salary in millions, mean
    satisfaction and the share with a manager, each rounded exactly."""
    e = t.employees
    n = F.count(F.lit(1))
    return e.agg(
        n.alias("employees"),
        pct(F.count_if(F.col("status") != "Active"), n, 2).alias("attrition_pct"),
        half_up_ratio(F.sum(F.col("monthly_salary_idr").cast(DEC)), F.count("monthly_salary_idr") * 1_000_000, 1).alias("avg_salary_m"),
        avg_rounded(F.col("satisfaction_score"), 2).alias("avg_satisfaction"),
        pct(F.count_if(F.col("manager_id").isNotNull()), n, 1).alias("with_manager_pct"),
    )


def p01_shape(t: HRTables) -> DataFrame:
    return P.shapes(t.as_dict())


def p02_head(t: HRTables) -> DataFrame:
    return P.head(t.employees, 5, ["employee_id"], ["employee_id", "full_name", "dept_id", "job_level"])


def p03_duplicate_rows(t: HRTables) -> DataFrame:
    emp_raw = raw_table(t, "employees")
    rev_raw = raw_table(t, "performance_reviews")
    return V.union_all(
        [
            P.duplicate_rows(emp_raw, "employees_raw"),
            P.duplicate_rows(drop_duplicate_rows(emp_raw), "employees_deduplicated"),
            P.duplicate_rows(rev_raw, "performance_reviews_raw"),
            P.duplicate_rows(drop_duplicate_rows(rev_raw), "performance_reviews_deduplicated"),
        ]
    )


def p04_distinct_values(t: HRTables) -> DataFrame:
    return P.distinct_values(raw_table(t, "employees"), "gender")


def p05_value_counts(t: HRTables) -> DataFrame:
    return P.value_counts(raw_table(t, "employees"), "gender")


def p06_parse_failures(t: HRTables) -> DataFrame:
    raw = F.col("hire_date")
    return raw_table(t, "employees").agg(
        *P.parse_failures(raw, parse_date_multi(raw), is_ambiguous_date(raw))
    )


def p07_missing_counts(t: HRTables) -> DataFrame:
    return P.missing_counts(clean_employees(raw_table(t, "employees")))


def p08_min_max(t: HRTables) -> DataFrame:
    return P.min_max(clean_employees(raw_table(t, "employees")), "hire_date")


def l2_cleaning_profile(t: HRTables) -> DataFrame:
    """The interactive cleaning session's checks over all five raw tables."""
    return P.cleaning_profile({name: raw_table(t, name) for name in t.as_dict()})


CHECK_QUERIES = {
    "v01_key_unique": v01_key_unique,
    "v02_dept_fk": v02_dept_fk,
    "v03_manager_fk": v03_manager_fk,
    "v04_gender_domain": v04_gender_domain,
    "v05_positive_salary": v05_positive_salary,
    "v06_extended_checks": v06_extended_checks,
    "a13_sanity_stats": a13_sanity_stats,
    "p01_shape": p01_shape,
    "p02_head": p02_head,
    "p03_duplicate_rows": p03_duplicate_rows,
    "p04_distinct_values": p04_distinct_values,
    "p05_value_counts": p05_value_counts,
    "p06_parse_failures": p06_parse_failures,
    "p07_missing_counts": p07_missing_counts,
    "p08_min_max": p08_min_max,
    "l2_cleaning_profile": l2_cleaning_profile,
}
