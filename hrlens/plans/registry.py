"""Registered queries: key -> (spark, data_dir) -> DataFrame, plus their
cross-check SQL. Keys carry the inventory id of the operator they exercise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hrlens.plans import analyses as A
from hrlens.plans import oracle_sql as O
from hrlens.plans.checks import CHECK_QUERIES
from hrlens.plans.cleaning_checks import CLEANING_QUERIES, tc1_clean_departments
from hrlens.plans.oracle_checks import CHECKS_SQL
from hrlens.plans.extensions import EXTENSION_QUERIES
from hrlens.plans.oracle_cleaning import CLEANING_SQL
from hrlens.plans.oracle_extensions import EXTENSIONS_SQL
from hrlens.plans.oracle_structures import STRUCTURES_SQL
from hrlens.plans.rules import RULE_QUERIES
from hrlens.plans.structures import STRUCTURE_QUERIES

# Query families over the HR views: key -> HRTables -> DataFrame.
VIEW_QUERIES = {**EXTENSION_QUERIES, **RULE_QUERIES, **CLEANING_QUERIES, **CHECK_QUERIES, **STRUCTURE_QUERIES}
VIEW_SQL = {**EXTENSIONS_SQL, **CLEANING_SQL, **CHECKS_SQL, **STRUCTURES_SQL}
from hrlens.sources.derive import hr_views

QueryFn = Callable[[SparkSession, str], DataFrame]

ANALYSIS_KEYS = [
    ("q01", "headcount_by_department"),
    ("q02", "avg_salary_by_level"),
    ("q03", "headcount_by_city_type"),
    ("q04", "headcount_by_type_city"),
    ("q05", "attrition_overall"),
    ("q06", "attrition_by_department"),
    ("q07", "attrition_vs_satisfaction"),
    ("q08", "attrition_by_tenure"),
    ("q09", "first_year_attrition_by_band"),
    ("q10", "first_year_attrition_by_type"),
    ("q11", "review_trend"),
    ("q12", "goal_achievement_by_department"),
    ("q13", "gender_pay_gap_by_level"),
    ("q14", "top3_salary_by_department"),
    ("q15", "salary_vs_peer_average"),
    ("q16", "salary_changes"),
    ("q17", "org_structure"),
    ("q18", "subordinate_counts"),
]


def _analysis(name: str) -> QueryFn:
    fn = A.ANALYSES[name][0]

    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return fn(hr_views(spark, data_dir))

    run.__name__ = name
    return run


# Queries that read tables beyond the five HR views: (spark, data_dir) -> DataFrame.
DIRECT_QUERIES: dict[str, QueryFn] = {"tc1_clean_departments": tc1_clean_departments}


def _on_views(fn) -> QueryFn:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return fn(hr_views(spark, data_dir))

    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, QueryFn]:
    """Every registered query: key -> (spark, data_dir) -> DataFrame over the
    derived HR views."""
    out: dict[str, QueryFn] = {}
    for qid, name in ANALYSIS_KEYS:
        out[f"{qid}_{name}"] = _analysis(name)
    for key, fn in VIEW_QUERIES.items():
        out[key] = _on_views(fn)
    out.update(DIRECT_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """The DuckDB cross-check SQL for every key of ``queries()``."""
    out: dict[str, str] = {}
    for qid, name in ANALYSIS_KEYS:
        out[f"{qid}_{name}"] = O.ANALYSES_SQL[name]
    out.update(VIEW_SQL)
    return out
