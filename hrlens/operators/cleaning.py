"""Per-table cleaners: raw all-string tables -> typed clean tables.

Each cleaner is one projection (one Project node, whole-stage codegen, no
Python), preceded where the table needs it by a full-row de-duplication on
the *raw* strings (rows equal only after cleaning are kept and surface in
the key-uniqueness check instead). ``keep`` names extra columns passed
through unchanged (e.g. a lineage digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.functions.parse import (
    canonical_gender,
    parse_currency,
    parse_date_multi,
    parse_percent,
    to_int,
    to_number,
)
from hrlens.functions.text import clean_name, clean_text, normalise_label, title_case
from hrlens.schemas import UNKNOWN


def fill_unknown(c, label: str = UNKNOWN):
    """A missing category becomes ``Unknown`` (only for category columns)."""
    return F.coalesce(c, F.lit(label))


def map_labels(
    df: DataFrame, col: str, mapping: DataFrame, out: str | None = None, default: str | None = None
) -> DataFrame:
    """C3 for dictionaries too large for a map literal: look up
    ``lower(strip(col))`` in a ``mapping(raw_label, label)`` table with a left
    join; unmapped -> ``default``; of two labels for one text, the smaller."""
    from hrlens.functions.text import strip

    m = mapping.groupBy(F.lower(strip(F.col("raw_label"))).alias("_raw")).agg(F.min("label").alias("_label"))
    keyed = df.withColumn("_raw_key", F.lower(strip(F.col(col))))
    joined = keyed.join(m, F.col("_raw_key") == F.col("_raw"), "left")
    value = F.coalesce(F.col("_label"), F.lit(default)) if default is not None else F.col("_label")
    return joined.withColumn(out or col, value).drop("_raw_key", "_raw", "_label")


def drop_duplicate_rows(raw: DataFrame) -> DataFrame:
    """Full-row duplicates on the raw strings; NULL equals NULL."""
    return raw.dropDuplicates()


def clean_departments(raw: DataFrame, casing: str | None = None, keep: tuple = ()) -> DataFrame:
    """Whitespace-only name fix by default; ``casing="title"`` also title-cases
    (``ENGINEERING`` -> ``Engineering``)."""
    name = clean_text(F.col("dept_name"))
    if casing == "title":
        name = title_case(name)
    return raw.select(
        to_int(F.col("dept_id")).alias("dept_id"),
        name.alias("dept_name"),
        F.col("division"),
        to_number(F.col("salary_band_mid")).alias("salary_band_mid"),
        *keep,
    )


def clean_employees(raw: DataFrame, keep: tuple = (), dedupe: bool = True) -> DataFrame:
    """Dedupe raw rows, then one projection: names collapsed and title-cased,
    gender mapped, status labelled, two dates parsed, salary read from Rp
    text, ids and scores typed, categories filled with Unknown."""
    # satisfaction_score and termination_date stay NULL where missing.
    # ``dedupe=False`` when the caller has already removed duplicate rows.
    return (drop_duplicate_rows(raw) if dedupe else raw).select(
        to_int(F.col("employee_id")).alias("employee_id"),
        clean_name(F.col("full_name")).alias("full_name"),
        fill_unknown(canonical_gender(F.col("gender"))).alias("gender"),
        to_int(F.col("dept_id")).alias("dept_id"),
        F.col("job_level"),
        fill_unknown(F.col("city")).alias("city"),
        fill_unknown(F.col("employment_type")).alias("employment_type"),
        parse_date_multi(F.col("hire_date")).alias("hire_date"),
        parse_date_multi(F.col("termination_date")).alias("termination_date"),
        normalise_label(F.col("status")).alias("status"),
        parse_currency(F.col("monthly_salary_idr")).alias("monthly_salary_idr"),
        to_number(F.col("satisfaction_score")).alias("satisfaction_score"),
        to_number(F.col("last_performance_score")).alias("last_performance_score"),
        to_int(F.col("manager_id")).alias("manager_id"),
        *keep,
    )


def clean_salaries(raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """One projection: date parsed, ids and amount typed, a missing reason
    becomes Unknown."""
    # No de-duplication: a repeated salary row is a real repeated event.
    return raw.select(
        to_int(F.col("salary_id")).alias("salary_id"),
        to_int(F.col("employee_id")).alias("employee_id"),
        parse_date_multi(F.col("effective_date")).alias("effective_date"),
        to_int(F.col("monthly_salary_idr")).alias("monthly_salary_idr"),
        fill_unknown(F.col("change_reason")).alias("change_reason"),
        *keep,
    )


def clean_reviews(raw: DataFrame, keep: tuple = (), dedupe: bool = True) -> DataFrame:
    """Dedupe raw rows, then type ids, score and the float-text reviewer id."""
    # reviewer_id arrives as float text (1234.0) and stays NULL where missing.
    return (drop_duplicate_rows(raw) if dedupe else raw).select(
        to_int(F.col("review_id")).alias("review_id"),
        to_int(F.col("employee_id")).alias("employee_id"),
        F.col("review_period"),
        to_number(F.col("review_score")).alias("review_score"),
        to_int(F.col("reviewer_id")).alias("reviewer_id"),
        *keep,
    )


def clean_goals(raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """One projection: achievement read from '85%' or '85.0', weight and ids
    typed."""
    # weight_pct stays NULL where missing.
    return raw.select(
        to_int(F.col("goal_id")).alias("goal_id"),
        to_int(F.col("employee_id")).alias("employee_id"),
        F.col("goal_title"),
        to_number(F.col("weight_pct")).alias("weight_pct"),
        parse_percent(F.col("achievement_pct")).alias("achievement_pct"),
        F.col("period"),
        *keep,
    )


CLEANERS = {
    "departments": clean_departments,
    "employees": clean_employees,
    "salaries": clean_salaries,
    "performance_reviews": clean_reviews,
    "goals": clean_goals,
}
