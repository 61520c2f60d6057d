"""The five HR tables as views derived from the TPC-H-style Parquet set.

The analyses are written against the clean five-table schema
(``schemas.clean_schema``). Test and benchmark data ship as TPC-H-style
tables, so each HR table is a projection of one of them with arithmetic both
Spark and a SQL cross-check evaluate identically (integer keys, modulus
buckets, exact decimals). Every view grows with its source table.

departments          nation JOIN region
employees            customer            (k = c_custkey)
salaries             orders
performance_reviews  events
goals                lineitem JOIN orders
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.functions.numeric import as_int, idiv
from hrlens.operators.joins import dealt, input_bytes
from hrlens.schemas import CITIES, DIVISIONS, LEVELS
from hrlens.sources.tables import read_table

# Stored orders beyond which their join is dealt out; Spark broadcasts the two
# columns it takes of smaller ones.
LARGE_BYTES = 64 << 20
HIRE_EPOCH = _dt.date(2012, 1, 1)


@dataclass(frozen=True)
class HRTables:
    departments: DataFrame
    employees: DataFrame
    salaries: DataFrame
    performance_reviews: DataFrame
    goals: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "departments": self.departments,
            "employees": self.employees,
            "salaries": self.salaries,
            "performance_reviews": self.performance_reviews,
            "goals": self.goals,
        }


def _pick(values: list[str], index) -> F.Column:
    """values[index] for a 0-based integral Column index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _finer(tenths, key) -> F.Column:
    """A score of 1.0 + ``tenths`` tenths; where ``key`` is a multiple of five,
    with three decimals (below the next tenth, and never above 5)."""
    more = F.when((key % 5 == 0) & (tenths < 40), key % 97).otherwise(0)
    return ((tenths + 10) * 100 + more) / 1000.0


def departments_view(spark: SparkSession, data_dir: str) -> DataFrame:
    nation = read_table(spark, data_dir, "nation")
    region = read_table(spark, data_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("dept_id"),
        F.col("n_name").alias("dept_name"),
        F.col("r_name").alias("division"),
        ((F.col("n_nationkey") * 3 + 80) / 2.0).cast("double").alias("salary_band_mid"),
    )


def employees_view(spark: SparkSession, data_dir: str) -> DataFrame:
    c = read_table(spark, data_dir, "customer")
    k = F.col("c_custkey")
    resigned = k % 7 == 0
    hire = F.date_add(F.lit(HIRE_EPOCH), ((k * 37) % 4700).cast("int"))
    return c.select(
        k.cast("bigint").alias("employee_id"),
        F.col("c_name").alias("full_name"),
        F.when(k % 25 == 0, "Unknown")
        .when(k % 2 == 0, "Male")
        .otherwise("Female")
        .alias("gender"),
        F.col("c_nationkey").cast("bigint").alias("dept_id"),
        _pick(LEVELS, idiv(k, F.lit(2)) % 7).alias("job_level"),
        _pick(CITIES, k % 6).alias("city"),
        F.when(k % 9 == 0, "Contract")
        .when(k % 10 == 0, "Probation")
        .otherwise("Permanent")
        .alias("employment_type"),
        hire.alias("hire_date"),
        F.when(resigned, F.date_add(hire, (30 + (k * 13) % 1500).cast("int"))).alias(
            "termination_date"
        ),
        F.when(resigned, "Resigned").otherwise("Active").alias("status"),
        (
            (idiv(as_int(F.col("c_acctbal"), 2), F.lit(100)) + 2000) * 10000
        ).alias("monthly_salary_idr"),
        F.when(k % 12 != 0, _finer(k % 41, k)).alias("satisfaction_score"),
        _finer(k % 31, k).alias("last_performance_score"),
        F.when(k != 0, idiv(k, F.lit(8))).alias("manager_id"),
    )


def salaries_view(spark: SparkSession, data_dir: str) -> DataFrame:
    o = read_table(spark, data_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("salary_id"),
        F.col("o_custkey").alias("employee_id"),
        F.to_date("o_orderdate").alias("effective_date"),
        as_int(F.col("o_totalprice"), 2).alias("monthly_salary_idr"),
        F.when(F.col("o_orderkey") % 20 == 0, "Unknown")
        .otherwise(F.col("o_orderpriority"))
        .alias("change_reason"),
    )


def reviews_view(spark: SparkSession, data_dir: str) -> DataFrame:
    e = read_table(spark, data_dir, "events")
    part = F.least(F.lit(4), idiv(F.dayofmonth("ts") + 7, F.lit(8)))
    boss = idiv(F.col("user_id"), F.lit(8))
    return e.select(
        F.col("event_id").alias("review_id"),
        F.col("user_id").alias("employee_id"),
        F.concat(F.lit("2024-P"), part.cast("string")).alias("review_period"),
        _finer(as_int(F.col("value"), 2) % 41, F.col("event_id")).alias("review_score"),
        F.when(boss != 0, boss).alias("reviewer_id"),
    )


def goals_view(spark: SparkSession, data_dir: str) -> DataFrame:
    li = read_table(spark, data_dir, "lineitem")
    o = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey")
    qty = as_int(F.col("l_quantity"))
    if (input_bytes(o) or 0) > LARGE_BYTES:
        # Both sides in parts that grow with the input: merged to one part per
        # core, a task would sort more and more rows.
        li, o = dealt(li, li, "l_orderkey"), dealt(o, li, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("goal_id"),
        F.col("o_custkey").alias("employee_id"),
        F.col("l_returnflag").alias("goal_title"),
        F.when(F.col("l_linenumber") != 7, (((qty % 5) * 5 + 20) * 1000 + qty % 3) / 1000.0).alias("weight_pct"),
        ((((as_int(F.col("l_discount"), 2) * 10 + qty) % 131) * 1000 + qty % 7) / 1000.0).alias("achievement_pct"),
        F.lit("2024").alias("period"),
    )


def departments_export_view(spark: SparkSession, data_dir: str) -> DataFrame:
    """A departments-shaped export that grows with the data: one department
    per supplier. The departments view itself (from nation and region) has
    the same 25 rows at every scale, so the departments cleaner is exercised
    on this one."""
    s = read_table(spark, data_dir, "supplier")
    division = _pick(DIVISIONS, F.col("s_nationkey") % 3)
    return s.select(
        F.col("s_suppkey").cast("bigint").alias("dept_id"),
        F.concat(F.col("s_name"), F.lit(" "), division).alias("dept_name"),
        division.alias("division"),
        ((F.col("s_nationkey") * 3 + 80) / 2.0).cast("double").alias("salary_band_mid"),
    )


_VIEWS: dict[tuple[int, str], HRTables] = {}


def hr_views(spark: SparkSession, data_dir: str) -> HRTables:
    """The five views (plans only; nothing is read until an action). Reused
    per session and folder, like the table handles under them."""
    key = (id(spark), data_dir)
    cached = _VIEWS.get(key)
    if cached is not None and cached.employees.sparkSession is spark:
        return cached
    _VIEWS[key] = _build_views(spark, data_dir)
    return _VIEWS[key]


def forget_views() -> None:
    """Drop cached views and table handles (after new files land, so the next
    query lists them again)."""
    from hrlens.sources.tables import forget_tables

    _VIEWS.clear()
    forget_tables()


def _build_views(spark: SparkSession, data_dir: str) -> HRTables:
    return HRTables(
        departments=departments_view(spark, data_dir),
        employees=employees_view(spark, data_dir),
        salaries=salaries_view(spark, data_dir),
        performance_reviews=reviews_view(spark, data_dir),
        goals=goals_view(spark, data_dir),
    )


# Review calendar of the derived reviews: periods split January 2024 into
# days 1-8, 9-16, 17-24 and 25-31 (see ``reviews_view``).
DERIVED_REVIEW_CALENDAR = [
    ("2024-P1", _dt.date(2024, 1, 8)),
    ("2024-P2", _dt.date(2024, 1, 16)),
    ("2024-P3", _dt.date(2024, 1, 24)),
    ("2024-P4", _dt.date(2024, 1, 31)),
]
