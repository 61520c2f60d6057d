"""Integrity checks as violation tables.

Every check returns ``(check, table_name, row_key, detail)`` rows, one per
violation, computed by distributed aggregations and anti joins; only the
violations (never the tables) are ever brought back, and only when a caller
asks with ``assert_valid``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.operators.joins import dealt, orphans
from hrlens.schemas import GENDER_DOMAIN


class ValidationError(AssertionError):
    pass


def _violations(df: DataFrame, check: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        key.cast("string").alias("row_key"),
        detail.cast("string").alias("detail"),
    )


def key_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Key values held by more than one row (NULL keys group together).

    Nearly every key is a group of its own, so the keys are dealt out before
    they are grouped: combining them first would hold them all, to no use."""
    dup = dealt(df.select(*keys), df, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    key = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return _violations(dup, f"unique:{'+'.join(keys)}", table, key, F.concat(F.lit("rows="), F.col("_n")))


def foreign_key(
    child: DataFrame, child_table: str, child_col: str, parent: DataFrame, parent_table: str, parent_col: str
) -> DataFrame:
    """Non-NULL ``child_col`` values missing from ``parent_col``."""
    missing = orphans(child, child_col, parent, parent_col)
    return _violations(
        missing,
        f"fk:{child_col}->{parent_table}.{parent_col}",
        child_table,
        F.col(child_col),
        F.lit("missing parent"),
    )


def foreign_keys(children: list[tuple[DataFrame, str, str]], parent: DataFrame, parent_table: str, parent_col: str) -> DataFrame:
    """``foreign_key`` for all columns ``(child, table, column)`` that refer to
    one parent, in one shuffle: the parent's keys and all children's, tagged,
    are grouped together (combined map-side, so a key that a third of the rows
    hold is one row a task); keys without a parent's tag are violations."""
    kind = parent.schema[parent_col].dataType
    keys = [parent.select(F.col(parent_col).alias("k"), F.lit(-1).alias("tag"))]
    keys += [df.where(F.col(c).isNotNull()).select(F.col(c).cast(kind).alias("k"), F.lit(i).alias("tag")) for i, (df, _, c) in enumerate(children)]
    seen = [F.bool_or(F.col("tag") == i).alias(f"c{i}") for i in range(len(children))]
    found = union_all(keys).where("k is not null").groupBy("k").agg(F.bool_or(F.col("tag") == -1).alias("held"), *seen).where("not held")
    checks = [
        F.when(F.col(f"c{i}"), F.struct(F.lit(f"fk:{c}->{parent_table}.{parent_col}").alias("check"), F.lit(table).alias("table_name")))
        for i, (_, table, c) in enumerate(children)
    ]
    each = found.select(F.explode(F.array_compact(F.array(*checks))).alias("c"), "k")
    return each.select("c.check", "c.table_name", F.col("k").cast("string").alias("row_key"), F.lit("missing parent").alias("detail"))


def in_domain(df: DataFrame, table: str, key: str, col: str, allowed: list[str]) -> DataFrame:
    """Values outside ``allowed``; NULL counts as outside (a bare NOT IN would
    let NULL through)."""
    c = F.col(col)
    bad = df.where(c.isNull() | ~c.isin(allowed))
    return _violations(bad, f"domain:{col}", table, F.col(key), F.coalesce(c.cast("string"), F.lit("NULL")))


def positive(df: DataFrame, table: str, key: str, col: str) -> DataFrame:
    """Present values that are not > 0 (NULL is allowed)."""
    bad = df.where(F.col(col) <= 0)
    return _violations(bad, f"positive:{col}", table, F.col(key), F.col(col))


def in_range(df: DataFrame, table: str, key: str, col: str, lo: float, hi: float) -> DataFrame:
    """Present values outside [lo, hi] (NULL is allowed)."""
    c = F.col(col)
    bad = df.where((c < lo) | (c > hi))
    return _violations(bad, f"range:{col}[{lo},{hi}]", table, F.col(key), c)


def row_checks(df: DataFrame, table: str, key: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Several row-level checks on one table in a single pass. ``checks``
    holds (check name, failing predicate, detail); each row yields one
    violation per failing check."""
    hits = F.array(
        *[
            F.when(bad, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
            for name, bad, detail in checks
        ]
    )
    found = df.select(
        F.col(key).cast("string").alias("row_key"),
        F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_v"),
    )
    return found.select(
        F.col("_v.check").alias("check"), F.lit(table).alias("table_name"), "row_key", F.col("_v.detail").alias("detail")
    )


def in_ranges(df: DataFrame, table: str, key: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Range checks of several columns in one pass (NULL is allowed)."""
    return row_checks(
        df,
        table,
        key,
        [
            (f"range:{c}[{lo},{hi}]", (F.col(c) < lo) | (F.col(c) > hi), F.col(c))
            for c, (lo, hi) in ranges.items()
        ],
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def validate_reference(emp: DataFrame, dept: DataFrame) -> DataFrame:
    """The five checks of the cleaning run: unique employee id, department
    FK, manager FK, gender domain, positive salary."""
    return union_all(
        [
            key_unique(emp, "employees", ["employee_id"]),
            foreign_key(emp, "employees", "dept_id", dept, "departments", "dept_id"),
            foreign_key(emp, "employees", "manager_id", emp, "employees", "employee_id"),
            # Domain and positive-salary checks share one scan of employees.
            row_checks(
                emp,
                "employees",
                "employee_id",
                [
                    (
                        "domain:gender",
                        F.col("gender").isNull() | ~F.col("gender").isin(GENDER_DOMAIN),
                        F.coalesce(F.col("gender"), F.lit("NULL")),
                    ),
                    ("positive:monthly_salary_idr", F.col("monthly_salary_idr") <= 0, F.col("monthly_salary_idr")),
                ],
            ),
        ]
    )


def validate_extended(tables) -> DataFrame:
    """The same kinds of checks for the other tables: primary keys, employee
    FKs, reviewer FK, score and achievement ranges."""
    emp = tables.employees
    sal, rev, goals = tables.salaries, tables.performance_reviews, tables.goals
    return union_all(
        [
            key_unique(tables.departments, "departments", ["dept_id"]),
            key_unique(sal, "salaries", ["salary_id"]),
            key_unique(rev, "performance_reviews", ["review_id"]),
            key_unique(goals, "goals", ["goal_id"]),
            foreign_keys(
                [
                    (sal, "salaries", "employee_id"),
                    (rev, "performance_reviews", "employee_id"),
                    (rev, "performance_reviews", "reviewer_id"),
                    (goals, "goals", "employee_id"),
                ],
                emp,
                "employees",
                "employee_id",
            ),
            in_ranges(
                emp,
                "employees",
                "employee_id",
                {"satisfaction_score": (1.0, 5.0), "last_performance_score": (1.0, 5.0)},
            ),
            in_range(rev, "performance_reviews", "review_id", "review_score", 1.0, 5.0),
            in_range(goals, "goals", "goal_id", "achievement_pct", 0.0, 130.0),
            positive(sal, "salaries", "salary_id", "monthly_salary_idr"),
        ]
    )


def validate_all(tables) -> DataFrame:
    return validate_reference(tables.employees, tables.departments).unionByName(
        validate_extended(tables)
    )


def assert_valid(violations: DataFrame, sample: int = 20) -> None:
    """Raise when any violation exists; the message carries at most
    ``sample`` of them (a bounded fetch, never the whole table)."""
    found = violations.limit(sample).collect()
    if found:
        lines = [f"{r.check} {r.table_name} {r.row_key}: {r.detail}" for r in found]
        raise ValidationError("integrity violations:\n" + "\n".join(lines))
