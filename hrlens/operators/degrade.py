"""Key-bucketed dirtier: clean typed tables -> raw all-string tables.

Used for round-trip tests of the cleaners at any scale. Every defect is a
function of the row's key bucket, so the same rows are dirtied the same way
under any partitioning or cluster size (unlike ``rand``). Defects follow the
source project's raw exports: four date spellings, name casing and stray
spaces, gender label variants, status casing, ``Rp`` amounts with dot
separators, trailing blanks, ``85%`` achievements, float-text reviewer ids,
missing cells and full-row duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrlens.schemas import TABLE_COLUMNS


def key_bucket(df: DataFrame, key: str, buckets: int = 1000, seed: int | None = None) -> Column:
    """Deterministic bucket in [0, buckets) from the row key: the key itself
    modulo ``buckets`` for integer keys without a seed (reproducible in any
    SQL engine), else a hash of (key, seed)."""
    dtype = df.schema[key].dataType
    if seed is None and isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.pmod(F.col(key), F.lit(buckets))
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed or 0)), F.lit(buckets))


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _date_text(d: Column, b: Column) -> Column:
    """40 % ISO, 30 % dd/MM/yyyy, 15 % MM/dd/yyyy, 15 % dd-MM-yyyy."""
    f = b % 20
    return (
        F.when(f < 8, F.date_format(d, "yyyy-MM-dd"))
        .when(f < 14, F.date_format(d, "dd/MM/yyyy"))
        .when(f < 17, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "dd-MM-yyyy"))
    )


def _with_duplicates(df: DataFrame, dup: Column) -> DataFrame:
    """Emit a second copy of the rows where ``dup`` holds (full-row
    duplicates), generated in the same pass (no second scan of the source)."""
    copies = F.when(dup, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def degrade_departments(dept: DataFrame, seed: int | None = None) -> DataFrame:
    b = key_bucket(dept, "dept_id", seed=seed)
    name = F.col("dept_name")
    return dept.select(
        _s(F.col("dept_id")).alias("dept_id"),
        F.when(b % 3 == 1, F.concat(name, F.lit(" ")))
        .when(b % 3 == 2, F.upper(name))
        .otherwise(name)
        .alias("dept_name"),
        F.col("division"),
        _s(F.col("salary_band_mid")).alias("salary_band_mid"),
    )


def degrade_employees(emp: DataFrame, seed: int | None = None) -> DataFrame:
    b = key_bucket(emp, "employee_id", seed=seed)
    name, g, status = F.col("full_name"), F.col("gender"), F.col("status")
    sal = F.col("monthly_salary_idr")
    variant = F.floor(b / 10) % 4
    gender = (
        F.when(g == "Male", _pick(["Male", "M", "male", "L"], variant))
        .when(g == "Female", _pick(["Female", "F", "female", "P"], variant))
        .otherwise(g)
    )
    out = emp.select(
        _s(F.col("employee_id")).alias("employee_id"),
        F.when(b % 10 == 0, F.upper(name))
        .when(b % 10 == 1, F.lower(name))
        .when(b % 10 == 2, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(b % 10 == 3, F.replace(name, F.lit(" "), F.lit("  ")))
        .otherwise(name)
        .alias("full_name"),
        F.when(b % 25 != 7, gender).alias("gender"),
        _s(F.col("dept_id")).alias("dept_id"),
        F.col("job_level"),
        F.when(b % 17 != 5, F.col("city")).alias("city"),
        F.when(b % 33 != 4, F.col("employment_type")).alias("employment_type"),
        _date_text(F.col("hire_date"), b).alias("hire_date"),
        F.date_format("termination_date", "yyyy-MM-dd").alias("termination_date"),
        F.when(F.floor(b / 3) % 3 == 1, F.upper(status))
        .when(F.floor(b / 3) % 3 == 2, F.lower(status))
        .otherwise(status)
        .alias("status"),
        F.when(b % 25 < 2, F.concat(F.lit("Rp"), F.translate(F.format_number(sal, 0), ",", ".")))
        .when(b % 25 == 2, F.concat(_s(sal), F.lit(" ")))
        .otherwise(_s(sal))
        .alias("monthly_salary_idr"),
        F.when(b % 12 != 11, _s(F.col("satisfaction_score"))).alias("satisfaction_score"),
        _s(F.col("last_performance_score")).alias("last_performance_score"),
        _s(F.col("manager_id")).alias("manager_id"),
    )
    return _with_duplicates(out, b % 67 == 3)


def degrade_salaries(sal: DataFrame, seed: int | None = None) -> DataFrame:
    b = key_bucket(sal, "salary_id", seed=seed)
    d = F.col("effective_date")
    return sal.select(
        _s(F.col("salary_id")).alias("salary_id"),
        _s(F.col("employee_id")).alias("employee_id"),
        F.when(b % 3 == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(b % 3 == 2, F.date_format(d, "dd-MM-yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
        .alias("effective_date"),
        _s(F.col("monthly_salary_idr")).alias("monthly_salary_idr"),
        F.when(b % 20 != 9, F.col("change_reason")).alias("change_reason"),
    )


def degrade_reviews(rev: DataFrame, seed: int | None = None) -> DataFrame:
    b = key_bucket(rev, "review_id", seed=seed)
    out = rev.select(
        _s(F.col("review_id")).alias("review_id"),
        _s(F.col("employee_id")).alias("employee_id"),
        F.col("review_period"),
        _s(F.col("review_score")).alias("review_score"),
        F.when(b % 25 != 13, _s(F.col("reviewer_id").cast("double"))).alias("reviewer_id"),
    )
    return _with_duplicates(out, b % 100 == 42)


def degrade_goals(goals: DataFrame, seed: int | None = None) -> DataFrame:
    b = key_bucket(goals, "goal_id", seed=seed)
    a = F.col("achievement_pct")
    return goals.select(
        _s(F.col("goal_id")).alias("goal_id"),
        _s(F.col("employee_id")).alias("employee_id"),
        F.col("goal_title"),
        F.when(b % 33 != 8, _s(F.col("weight_pct"))).alias("weight_pct"),
        F.when(b % 3 == 1, F.concat(_s(a.cast("bigint")), F.lit("%")))
        .otherwise(_s(a))
        .alias("achievement_pct"),
        F.col("period"),
    )


DEGRADERS = {
    "departments": degrade_departments,
    "employees": degrade_employees,
    "salaries": degrade_salaries,
    "performance_reviews": degrade_reviews,
    "goals": degrade_goals,
}


def degrade_rows(table: str, df: DataFrame, seed: int | None = None) -> DataFrame:
    """Raw all-string version of a clean table; ``seed`` picks a different
    (still deterministic) set of rows for each defect."""
    out = DEGRADERS[table](df, seed=seed)
    return out.select(*TABLE_COLUMNS[table])
