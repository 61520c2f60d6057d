"""Queries over the cleaners: dirty raw strings derived (by key bucket) from
the HR views, cleaned back by the column cleaners and the per-table cleaners.

Every query reads whole tables; raw strings are derived, never sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.functions.parse import (
    canonical_gender,
    is_ambiguous_date,
    parse_currency,
    parse_date_multi,
    parse_percent,
    to_int,
    to_number,
)
from hrlens.functions.text import clean_name, clean_text, normalise_label
from hrlens.operators.cleaning import CLEANERS, drop_duplicate_rows
from hrlens.operators.degrade import degrade_rows
from hrlens.sources.derive import HRTables, departments_export_view


def raw_table(t: HRTables, table: str) -> DataFrame:
    return degrade_rows(table, t.as_dict()[table])


def _column_case(t: HRTables, table: str, key: str, col: str, fn, out: str) -> DataFrame:
    raw = raw_table(t, table)
    return raw.select(
        F.col(key).alias("row_key"), F.col(col).alias("raw_value"), fn(F.col(col)).alias(out)
    )


def c01_clean_text(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "full_name", clean_text, "cleaned")


def c02_title_case(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "full_name", clean_name, "cleaned")


def c03_canonical_gender(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "gender", canonical_gender, "cleaned")


def c04_normalise_label(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "status", normalise_label, "cleaned")


def c05_parse_date_multi(t: HRTables) -> DataFrame:
    raw = raw_table(t, "employees")
    return raw.select(
        F.col("employee_id").alias("row_key"),
        F.col("hire_date").alias("raw_value"),
        parse_date_multi(F.col("hire_date")).alias("parsed"),
        is_ambiguous_date(F.col("hire_date")).alias("is_ambiguous"),
    )


def c06_parse_currency(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "monthly_salary_idr", parse_currency, "parsed")


def c07_parse_percent(t: HRTables) -> DataFrame:
    return _column_case(t, "goals", "goal_id", "achievement_pct", parse_percent, "parsed")


def c08_to_number(t: HRTables) -> DataFrame:
    return _column_case(t, "employees", "employee_id", "satisfaction_score", to_number, "parsed")


def c09_to_int(t: HRTables) -> DataFrame:
    return _column_case(t, "performance_reviews", "review_id", "reviewer_id", to_int, "parsed")


def c12_drop_duplicates(t: HRTables) -> DataFrame:
    return drop_duplicate_rows(raw_table(t, "employees"))


def _clean(table: str):
    def run(t: HRTables) -> DataFrame:
        return CLEANERS[table](raw_table(t, table))

    run.__name__ = f"clean_{table}"
    return run


def r5_round_trip(t: HRTables) -> DataFrame:
    """Per column of employees: rows where clean(degrade(x)) differs from x.

    Expected differences: names (title-casing), month-first dates read
    day-first when both fit, and cells the dirtier blanked."""
    clean = CLEANERS["employees"](raw_table(t, "employees"))
    src = t.employees
    cols = [c for c in src.columns if c != "employee_id"]
    joined = src.alias("s").join(clean.alias("c"), "employee_id")
    aggs = [
        F.count_if(~F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))).alias(c) for c in cols
    ]
    wide = joined.agg(F.count(F.lit(1)).alias("rows_compared"), *aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(
        "rows_compared", f"stack({len(cols)}, {stack}) as (column_name, mismatches)"
    )


CLEANING_QUERIES = {
    "c01_clean_text": c01_clean_text,
    "c02_title_case": c02_title_case,
    "c03_canonical_gender": c03_canonical_gender,
    "c04_normalise_label": c04_normalise_label,
    "c05_parse_date_multi": c05_parse_date_multi,
    "c06_parse_currency": c06_parse_currency,
    "c07_parse_percent": c07_parse_percent,
    "c08_to_number": c08_to_number,
    "c09_to_int": c09_to_int,
    "c12_drop_duplicates": c12_drop_duplicates,
    # tc1 runs on a departments export that grows with the data (see
    # ``registry.DIRECT_QUERIES``).
    "tc2_clean_employees": _clean("employees"),
    "tc3_clean_salaries": _clean("salaries"),
    "tc4_clean_reviews": _clean("performance_reviews"),
    "tc5_clean_goals": _clean("goals"),
    "r5_round_trip": r5_round_trip,
}


def tc1_clean_departments(spark, data_dir: str) -> DataFrame:
    """TC1 over a departments-shaped export derived from supplier (it grows
    with the data; the 25-row departments view would not)."""
    return CLEANERS["departments"](degrade_rows("departments", departments_export_view(spark, data_dir)))
