"""Cross-check SQL (DuckDB) for the cleaner queries: the same key-bucket
dirtier and the same cleaners, written directly in SQL."""

from __future__ import annotations

from hrlens.plans.oracle_sql import with_views
from hrlens.schemas import DIVISIONS

WS = r"[\s\x0B\x{85}\p{Z}\x1C-\x1F]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_text(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1)"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_transform({runs}, "
        f"lambda r: upper(r[1]) || lower(r[2:])), '') END"
    )


def gender(x: str) -> str:
    return (
        f"CASE lower({strip(x)}) WHEN 'male' THEN 'Male' WHEN 'm' THEN 'Male' "
        f"WHEN 'l' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'f' THEN 'Female' "
        f"WHEN 'p' THEN 'Female' END"
    )


def blank_null(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN {strip(x)} END"


def parse_date(x: str) -> str:
    t = blank_null(x)
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({t}, '{f}')" for f in fmts) + ") AS DATE)"


def ambiguous(x: str) -> str:
    t = blank_null(x)
    dm = f"try_strptime({t}, '%d/%m/%Y')"
    md = f"try_strptime({t}, '%m/%d/%Y')"
    return f"coalesce({dm} IS NOT NULL AND {md} IS NOT NULL AND {dm} <> {md}, false)"


def currency(x: str) -> str:
    return f"try_cast(regexp_replace({strip(x)}, 'Rp|[., ]', '', 'g') AS BIGINT)"


def to_number(x: str) -> str:
    d = f"try_cast({strip(x)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({d}) THEN {d} END"


def percent(x: str) -> str:
    return to_number(f"replace({x}, '%', '')")


def to_int(x: str) -> str:
    t = strip(x)
    d = to_number(x)
    exact = f"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN try_cast({t} AS BIGINT) END"
    return f"coalesce({exact}, CASE WHEN {d} = floor({d}) THEN try_cast({d} AS BIGINT) END)"


def fill(x: str) -> str:
    return f"coalesce({x}, 'Unknown')"


def _pick(values: list[str], idx: str) -> str:
    lst = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"list_extract({lst}, CAST({idx} + 1 AS INTEGER))"


RAW = {
    "departments": """
        SELECT CAST(dept_id AS VARCHAR) AS dept_id,
               CASE WHEN b % 3 = 1 THEN dept_name || ' ' WHEN b % 3 = 2 THEN upper(dept_name)
                    ELSE dept_name END AS dept_name,
               division, CAST(salary_band_mid AS VARCHAR) AS salary_band_mid
        FROM (SELECT *, dept_id % 1000 AS b FROM departments)""",
    "employees": f"""
        WITH d AS (
          SELECT CAST(employee_id AS VARCHAR) AS employee_id,
                 CASE WHEN b % 10 = 0 THEN upper(full_name) WHEN b % 10 = 1 THEN lower(full_name)
                      WHEN b % 10 = 2 THEN '  ' || full_name || ' '
                      WHEN b % 10 = 3 THEN replace(full_name, ' ', '  ') ELSE full_name END AS full_name,
                 CASE WHEN b % 25 <> 7 THEN
                      CASE WHEN gender = 'Male' THEN {_pick(['Male', 'M', 'male', 'L'], '(b // 10) % 4')}
                           WHEN gender = 'Female' THEN {_pick(['Female', 'F', 'female', 'P'], '(b // 10) % 4')}
                           ELSE gender END END AS gender,
                 CAST(dept_id AS VARCHAR) AS dept_id, job_level,
                 CASE WHEN b % 17 <> 5 THEN city END AS city,
                 CASE WHEN b % 33 <> 4 THEN employment_type END AS employment_type,
                 CASE WHEN b % 20 < 8 THEN strftime(hire_date, '%Y-%m-%d')
                      WHEN b % 20 < 14 THEN strftime(hire_date, '%d/%m/%Y')
                      WHEN b % 20 < 17 THEN strftime(hire_date, '%m/%d/%Y')
                      ELSE strftime(hire_date, '%d-%m-%Y') END AS hire_date,
                 strftime(termination_date, '%Y-%m-%d') AS termination_date,
                 CASE WHEN (b // 3) % 3 = 1 THEN upper(status) WHEN (b // 3) % 3 = 2 THEN lower(status)
                      ELSE status END AS status,
                 CASE WHEN b % 25 < 2 THEN 'Rp' || replace(format('{{:,}}', monthly_salary_idr), ',', '.')
                      WHEN b % 25 = 2 THEN CAST(monthly_salary_idr AS VARCHAR) || ' '
                      ELSE CAST(monthly_salary_idr AS VARCHAR) END AS monthly_salary_idr,
                 CASE WHEN b % 12 <> 11 THEN CAST(satisfaction_score AS VARCHAR) END AS satisfaction_score,
                 CAST(last_performance_score AS VARCHAR) AS last_performance_score,
                 CAST(manager_id AS VARCHAR) AS manager_id,
                 b
          FROM (SELECT *, employee_id % 1000 AS b FROM employees))
        SELECT * EXCLUDE (b) FROM d
        UNION ALL
        SELECT * EXCLUDE (b) FROM d WHERE b % 67 = 3""",
    "salaries": """
        SELECT CAST(salary_id AS VARCHAR) AS salary_id, CAST(employee_id AS VARCHAR) AS employee_id,
               CASE WHEN b % 3 = 1 THEN strftime(effective_date, '%d/%m/%Y')
                    WHEN b % 3 = 2 THEN strftime(effective_date, '%d-%m-%Y')
                    ELSE strftime(effective_date, '%Y-%m-%d') END AS effective_date,
               CAST(monthly_salary_idr AS VARCHAR) AS monthly_salary_idr,
               CASE WHEN b % 20 <> 9 THEN change_reason END AS change_reason
        FROM (SELECT *, salary_id % 1000 AS b FROM salaries)""",
    "performance_reviews": """
        WITH d AS (
          SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(employee_id AS VARCHAR) AS employee_id,
                 review_period, CAST(review_score AS VARCHAR) AS review_score,
                 CASE WHEN b % 25 <> 13 THEN CAST(CAST(reviewer_id AS DOUBLE) AS VARCHAR) END AS reviewer_id,
                 b
          FROM (SELECT *, review_id % 1000 AS b FROM performance_reviews))
        SELECT * EXCLUDE (b) FROM d
        UNION ALL
        SELECT * EXCLUDE (b) FROM d WHERE b % 100 = 42""",
    "goals": """
        SELECT CAST(goal_id AS VARCHAR) AS goal_id, CAST(employee_id AS VARCHAR) AS employee_id,
               goal_title,
               CASE WHEN b % 33 <> 8 THEN CAST(weight_pct AS VARCHAR) END AS weight_pct,
               CASE WHEN b % 3 = 1 THEN CAST(CAST(trunc(achievement_pct) AS BIGINT) AS VARCHAR) || '%'
                    ELSE CAST(achievement_pct AS VARCHAR) END AS achievement_pct,
               period
        FROM (SELECT *, goal_id % 1000 AS b FROM goals)""",
}

CLEAN = {
    "departments": f"""
        SELECT {to_int('dept_id')} AS dept_id, {clean_text('dept_name')} AS dept_name, division,
               {to_number('salary_band_mid')} AS salary_band_mid
        FROM raw_departments""",
    "employees": f"""
        SELECT {to_int('employee_id')} AS employee_id,
               {title(clean_text('full_name'))} AS full_name,
               {fill(gender('gender'))} AS gender,
               {to_int('dept_id')} AS dept_id, job_level,
               {fill('city')} AS city, {fill('employment_type')} AS employment_type,
               {parse_date('hire_date')} AS hire_date,
               {parse_date('termination_date')} AS termination_date,
               {title(strip('status'))} AS status,
               {currency('monthly_salary_idr')} AS monthly_salary_idr,
               {to_number('satisfaction_score')} AS satisfaction_score,
               {to_number('last_performance_score')} AS last_performance_score,
               {to_int('manager_id')} AS manager_id
        FROM (SELECT DISTINCT * FROM raw_employees)""",
    "salaries": f"""
        SELECT {to_int('salary_id')} AS salary_id, {to_int('employee_id')} AS employee_id,
               {parse_date('effective_date')} AS effective_date,
               {to_int('monthly_salary_idr')} AS monthly_salary_idr,
               {fill('change_reason')} AS change_reason
        FROM raw_salaries""",
    "performance_reviews": f"""
        SELECT {to_int('review_id')} AS review_id, {to_int('employee_id')} AS employee_id,
               review_period, {to_number('review_score')} AS review_score,
               {to_int('reviewer_id')} AS reviewer_id
        FROM (SELECT DISTINCT * FROM raw_performance_reviews)""",
    "goals": f"""
        SELECT {to_int('goal_id')} AS goal_id, {to_int('employee_id')} AS employee_id, goal_title,
               {to_number('weight_pct')} AS weight_pct, {percent('achievement_pct')} AS achievement_pct,
               period
        FROM raw_goals""",
}


def _with_raw(body: str, table: str) -> str:
    views = ["departments"] if table == "departments" else ["employees"]
    if table != "departments" and table != "employees":
        views = [table]
    return with_views(body, *views, extra={f"raw_{table}": RAW[table]})


def _column(table: str, key: str, col: str, expr: str, out: str) -> str:
    return _with_raw(
        f"SELECT {key} AS row_key, {col} AS raw_value, {expr} AS {out} FROM raw_{table}", table
    )


def _round_trip() -> str:
    cols = [
        "full_name", "gender", "dept_id", "job_level", "city", "employment_type", "hire_date",
        "termination_date", "status", "monthly_salary_idr", "satisfaction_score",
        "last_performance_score", "manager_id",
    ]
    counts = ", ".join(
        f"count(*) FILTER (WHERE s.{c} IS DISTINCT FROM c.{c}) AS {c}" for c in cols
    )
    unions = " UNION ALL ".join(
        f"SELECT rows_compared, '{c}' AS column_name, {c} AS mismatches FROM w" for c in cols
    )
    body = (
        f"SELECT * FROM ({unions})"
    )
    return with_views(
        body,
        "employees",
        extra={
            "raw_employees": RAW["employees"],
            "clean_employees": CLEAN["employees"],
            "w": f"""SELECT count(*) AS rows_compared, {counts}
                     FROM employees s JOIN clean_employees c ON c.employee_id = s.employee_id""",
        },
    )


CLEANING_SQL = {
    "c01_clean_text": _column("employees", "employee_id", "full_name", clean_text("full_name"), "cleaned"),
    "c02_title_case": _column("employees", "employee_id", "full_name", title(clean_text("full_name")), "cleaned"),
    "c03_canonical_gender": _column("employees", "employee_id", "gender", gender("gender"), "cleaned"),
    "c04_normalise_label": _column("employees", "employee_id", "status", title(strip("status")), "cleaned"),
    "c05_parse_date_multi": _with_raw(
        f"""SELECT employee_id AS row_key, hire_date AS raw_value,
                   {parse_date('hire_date')} AS parsed, {ambiguous('hire_date')} AS is_ambiguous
            FROM raw_employees""",
        "employees",
    ),
    "c06_parse_currency": _column("employees", "employee_id", "monthly_salary_idr", currency("monthly_salary_idr"), "parsed"),
    "c07_parse_percent": _column("goals", "goal_id", "achievement_pct", percent("achievement_pct"), "parsed"),
    "c08_to_number": _column("employees", "employee_id", "satisfaction_score", to_number("satisfaction_score"), "parsed"),
    "c09_to_int": _column("performance_reviews", "review_id", "reviewer_id", to_int("reviewer_id"), "parsed"),
    "c12_drop_duplicates": _with_raw("SELECT DISTINCT * FROM raw_employees", "employees"),
    "tc1_clean_departments": with_views(
        CLEAN["departments"],
        extra={
            "dept_export": f"""
                SELECT CAST(s_suppkey AS BIGINT) AS dept_id,
                       s_name || ' ' || {_pick(DIVISIONS, 's_nationkey % 3')} AS dept_name,
                       {_pick(DIVISIONS, 's_nationkey % 3')} AS division,
                       CAST((s_nationkey * 3 + 80) / 2.0 AS DOUBLE) AS salary_band_mid
                FROM supplier""",
            "raw_departments": RAW["departments"].replace("FROM departments)", "FROM dept_export)"),
        },
    ),
    "tc2_clean_employees": _with_raw(CLEAN["employees"], "employees"),
    "tc3_clean_salaries": _with_raw(CLEAN["salaries"], "salaries"),
    "tc4_clean_reviews": _with_raw(CLEAN["performance_reviews"], "performance_reviews"),
    "tc5_clean_goals": _with_raw(CLEAN["goals"], "goals"),
    "r5_round_trip": _round_trip(),
}
