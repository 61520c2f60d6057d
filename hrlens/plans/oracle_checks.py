"""Cross-check SQL (DuckDB) for the validation and profiling queries."""

from __future__ import annotations

from hrlens.plans.oracle_cleaning import CLEAN, RAW, ambiguous, currency, parse_date, percent
from hrlens.plans.oracle_sql import avg_rounded, hu_ratio, pct, with_views
from hrlens.schemas import TABLE_COLUMNS


def _v(check: str, table: str, key: str, detail: str, src: str) -> str:
    return (
        f"""SELECT '{check}' AS "check", '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key,
                   CAST({detail} AS VARCHAR) AS detail FROM {src}"""
    )


def unique(table: str, key: str) -> str:
    src = f"(SELECT {key}, count(*) AS n FROM {table} GROUP BY {key} HAVING count(*) > 1)"
    return _v(f"unique:{key}", table, f"coalesce(CAST({key} AS VARCHAR), 'NULL')", "'rows=' || CAST(n AS VARCHAR)", src)


def fk(child: str, col: str, parent: str, pcol: str) -> str:
    src = (
        f"(SELECT DISTINCT {col} AS fk FROM {child} WHERE {col} IS NOT NULL) c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.fk)"
    )
    return _v(f"fk:{col}->{parent}.{pcol}", child, "fk", "'missing parent'", src)


def domain(table: str, key: str, col: str, allowed: list[str]) -> str:
    vals = ", ".join(f"'{a}'" for a in allowed)
    src = f"{table} WHERE {col} IS NULL OR {col} NOT IN ({vals})"
    return _v(f"domain:{col}", table, key, f"coalesce(CAST({col} AS VARCHAR), 'NULL')", src)


def positive(table: str, key: str, col: str) -> str:
    return _v(f"positive:{col}", table, key, col, f"{table} WHERE {col} <= 0")


def in_range(table: str, key: str, col: str, lo: float, hi: float) -> str:
    return _v(f"range:{col}[{lo},{hi}]", table, key, col, f"{table} WHERE {col} < {lo} OR {col} > {hi}")


ALL = ["departments", "employees", "salaries", "performance_reviews", "goals"]

EXTENDED = " UNION ALL ".join(
    [
        unique("departments", "dept_id"),
        unique("salaries", "salary_id"),
        unique("performance_reviews", "review_id"),
        unique("goals", "goal_id"),
        fk("salaries", "employee_id", "employees", "employee_id"),
        fk("performance_reviews", "employee_id", "employees", "employee_id"),
        fk("performance_reviews", "reviewer_id", "employees", "employee_id"),
        fk("goals", "employee_id", "employees", "employee_id"),
        in_range("employees", "employee_id", "satisfaction_score", 1.0, 5.0),
        in_range("employees", "employee_id", "last_performance_score", 1.0, 5.0),
        in_range("performance_reviews", "review_id", "review_score", 1.0, 5.0),
        in_range("goals", "goal_id", "achievement_pct", 0.0, 130.0),
        positive("salaries", "salary_id", "monthly_salary_idr"),
    ]
)


def _dups(label: str, src: str, table: str) -> str:
    cols = ", ".join(TABLE_COLUMNS[table])
    return (
        f"SELECT '{label}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT {cols}, count(*) AS n FROM {src} GROUP BY {cols})"
    )


def _missing() -> str:
    cols = TABLE_COLUMNS["employees"]
    parts = [
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM clean_employees"
        for c in cols
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE missing > 0"


def _profile() -> str:
    parts = []
    for t in ALL:
        cols = ", ".join(TABLE_COLUMNS[t])
        grouped = f"(SELECT {cols}, count(*) AS n FROM raw_{t} GROUP BY {cols})"
        parts.append(f"SELECT '{t}' AS table_name, 'raw_rows' AS metric, CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM {grouped}")
        parts.append(f"SELECT '{t}', 'raw_duplicate_rows', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM {grouped}")
        parts.append(f"SELECT '{t}', 'clean_rows', count(*) FROM clean_{t}")
        for c in TABLE_COLUMNS[t]:
            parts.append(
                f"SELECT * FROM (SELECT '{t}', 'null_after_cleaning:{c}', count(*) FILTER (WHERE {c} IS NULL) AS v "
                f"FROM clean_{t}) WHERE v > 0"
            )
    parts.append(
        f"""SELECT 'employees', 'unparsed:hire_date',
                   count(*) FILTER (WHERE hire_date IS NOT NULL AND {parse_date('hire_date')} IS NULL) FROM (SELECT DISTINCT * FROM raw_employees)"""
    )
    parts.append(
        f"SELECT 'employees', 'ambiguous:hire_date', count(*) FILTER (WHERE {ambiguous('hire_date')}) "
        f"FROM (SELECT DISTINCT * FROM raw_employees)"
    )
    parts.append(
        f"""SELECT 'employees', 'unparsed:termination_date',
                   count(*) FILTER (WHERE termination_date IS NOT NULL AND {parse_date('termination_date')} IS NULL)
            FROM (SELECT DISTINCT * FROM raw_employees)"""
    )
    parts.append(
        f"""SELECT 'employees', 'unparsed:monthly_salary_idr',
                   count(*) FILTER (WHERE monthly_salary_idr IS NOT NULL AND {currency('monthly_salary_idr')} IS NULL)
            FROM (SELECT DISTINCT * FROM raw_employees)"""
    )
    parts.append(
        f"""SELECT 'salaries', 'unparsed:effective_date',
                   count(*) FILTER (WHERE effective_date IS NOT NULL AND {parse_date('effective_date')} IS NULL) FROM raw_salaries"""
    )
    parts.append(f"SELECT 'salaries', 'ambiguous:effective_date', count(*) FILTER (WHERE {ambiguous('effective_date')}) FROM raw_salaries")
    parts.append(
        f"""SELECT 'goals', 'unparsed:achievement_pct',
                   count(*) FILTER (WHERE achievement_pct IS NOT NULL AND {percent('achievement_pct')} IS NULL) FROM raw_goals"""
    )
    extra = {f"raw_{t}": RAW[t] for t in ALL}
    extra.update({f"clean_{t}": CLEAN[t] for t in ALL})
    return with_views(" UNION ALL ".join(parts), *ALL, extra=extra)


_RAW_EMP = {"raw_employees": RAW["employees"]}
_CLEAN_EMP = {"raw_employees": RAW["employees"], "clean_employees": CLEAN["employees"]}

CHECKS_SQL = {
    "v01_key_unique": with_views(unique("employees", "employee_id"), "employees"),
    "v02_dept_fk": with_views(fk("employees", "dept_id", "departments", "dept_id"), "departments", "employees"),
    "v03_manager_fk": with_views(fk("employees", "manager_id", "employees", "employee_id"), "employees"),
    "v04_gender_domain": with_views(domain("employees", "employee_id", "gender", ["Male", "Female", "Unknown"]), "employees"),
    "v05_positive_salary": with_views(positive("employees", "employee_id", "monthly_salary_idr"), "employees"),
    "v06_extended_checks": with_views(EXTENDED, *ALL),
    "a13_sanity_stats": with_views(
        f"""SELECT count(*) AS employees,
                   {pct("count(*) FILTER (WHERE status <> 'Active')", 'count(*)', 2)} AS attrition_pct,
                   {hu_ratio('sum(CAST(monthly_salary_idr AS HUGEINT))', 'count(monthly_salary_idr) * 1000000', 1)} AS avg_salary_m,
                   {avg_rounded('satisfaction_score', 2)} AS avg_satisfaction,
                   {pct('count(*) FILTER (WHERE manager_id IS NOT NULL)', 'count(*)', 1)} AS with_manager_pct
            FROM employees""",
        "employees",
    ),
    "p01_shape": with_views(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS rows, CAST({len(TABLE_COLUMNS[t])} AS BIGINT) AS cols FROM {t}"
            for t in ALL
        ),
        *ALL,
    ),
    "p02_head": with_views(
        "SELECT employee_id, full_name, dept_id, job_level FROM employees ORDER BY employee_id LIMIT 5",
        "employees",
    ),
    "p03_duplicate_rows": with_views(
        " UNION ALL ".join(
            [
                _dups("employees_raw", "raw_employees", "employees"),
                _dups("employees_deduplicated", "(SELECT DISTINCT * FROM raw_employees)", "employees"),
                _dups("performance_reviews_raw", "raw_performance_reviews", "performance_reviews"),
                _dups(
                    "performance_reviews_deduplicated",
                    "(SELECT DISTINCT * FROM raw_performance_reviews)",
                    "performance_reviews",
                ),
            ]
        ),
        "employees", "performance_reviews",
        extra={"raw_employees": RAW["employees"], "raw_performance_reviews": RAW["performance_reviews"]},
    ),
    "p04_distinct_values": with_views(
        "SELECT DISTINCT gender FROM raw_employees WHERE gender IS NOT NULL", "employees", extra=_RAW_EMP
    ),
    "p05_value_counts": with_views(
        "SELECT gender, count(*) AS rows FROM raw_employees GROUP BY gender", "employees", extra=_RAW_EMP
    ),
    "p06_parse_failures": with_views(
        f"""SELECT count(*) FILTER (WHERE hire_date IS NOT NULL AND {parse_date('hire_date')} IS NULL) AS unparsed,
                   count(*) FILTER (WHERE {ambiguous('hire_date')}) AS ambiguous
            FROM raw_employees""",
        "employees", extra=_RAW_EMP,
    ),
    "p07_missing_counts": with_views(_missing(), "employees", extra=_CLEAN_EMP),
    "l2_cleaning_profile": _profile(),
    "p08_min_max": with_views(
        "SELECT min(hire_date) AS min_value, max(hire_date) AS max_value FROM clean_employees",
        "employees", extra=_CLEAN_EMP,
    ),
}
