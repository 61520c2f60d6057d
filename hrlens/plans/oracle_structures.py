"""Cross-check SQL (DuckDB) for the queries of ``plans.structures``."""

from __future__ import annotations

from hrlens.plans.oracle_checks import domain, fk, positive, unique
from hrlens.plans.oracle_cleaning import _with_raw, blank_null, parse_date
from hrlens.plans.oracle_sql import with_views
from hrlens.plans.structures import CALENDAR_START, PERIOD_DAYS, PERIODS, SNAPSHOT
from hrlens.schemas import GENDER_DOMAIN

FAULTY = """
SELECT employee_id, CASE WHEN employee_id % 40 = 1 THEN 1000 + employee_id % 7 ELSE dept_id END AS dept_id,
       CASE WHEN employee_id % 30 = 3 THEN 'X' WHEN employee_id % 30 = 4 THEN NULL ELSE gender END AS gender,
       CASE WHEN employee_id % 45 = 5 THEN -monthly_salary_idr WHEN employee_id % 45 = 6 THEN 0
            ELSE monthly_salary_idr END AS monthly_salary_idr,
       CASE WHEN employee_id % 35 = 2 THEN 10000000 + employee_id % 11 ELSE manager_id END AS manager_id
FROM staff,
     unnest(range(CASE WHEN employee_id % 100 = 0 THEN 3 WHEN employee_id % 50 = 0 THEN 2 ELSE 1 END)) AS u(i)
"""
STAFF = "SELECT * FROM employees"
CALENDAR = f"""
SELECT p AS period_no, DATE '{CALENDAR_START}' + CAST(p * {PERIOD_DAYS} AS INTEGER) AS period_start,
       DATE '{CALENDAR_START}' + CAST(p * {PERIOD_DAYS} + {PERIOD_DAYS - 1} AS INTEGER) AS period_end
FROM range({PERIODS}) AS r(p)
"""


def _planted(body: str, *views: str) -> str:
    """``body`` where ``faulty`` names the employees with planted faults."""
    return with_views(body, "employees", *views, extra={"staff": STAFF, "faulty": FAULTY})


def _named(sql: str) -> str:
    return sql.replace("'faulty' AS table_name", "'employees' AS table_name")


def _evidence(column: str, src: str) -> str:
    t = blank_null(column)
    day, month = f"try_strptime({t}, '%d/%m/%Y')", f"try_strptime({t}, '%m/%d/%Y')"
    return f"""
    SELECT '{column}' AS column_name,
           count(*) FILTER (WHERE {day} IS NOT NULL AND {month} IS NULL) AS day_first_only,
           count(*) FILTER (WHERE {month} IS NOT NULL AND {day} IS NULL) AS month_first_only,
           count(*) FILTER (WHERE {day} IS NOT NULL AND {month} IS NOT NULL) AS either,
           count(*) FILTER (WHERE {day} IS NULL AND {month} IS NULL AND {parse_date(column)} IS NOT NULL) AS other_format,
           count(*) FILTER (WHERE {parse_date(column)} IS NULL) AS unread,
           CASE WHEN count(*) FILTER (WHERE {month} IS NOT NULL AND {day} IS NULL)
                   > count(*) FILTER (WHERE {day} IS NOT NULL AND {month} IS NULL)
                THEN 'month_first' ELSE 'day_first' END AS chosen
    FROM {src}"""


_US = """(SELECT CASE WHEN (length(full_name) + length(city)) % 9 = 0 THEN strftime(hire_date, '%d/%m/%Y')
                      ELSE strftime(hire_date, '%m/%d/%Y') END AS us_date FROM employees)"""

STRUCTURES_SQL = {
    "v01_planted_keys": _planted(_named(unique("faulty", "employee_id"))),
    "v02_planted_departments": _planted(_named(fk("faulty", "dept_id", "departments", "dept_id")), "departments"),
    "v03_planted_managers": _planted(_named(fk("faulty", "manager_id", "employees", "employee_id"))),
    "v04_planted_genders": _planted(_named(domain("faulty", "employee_id", "gender", GENDER_DOMAIN))),
    "v05_planted_salaries": _planted(_named(positive("faulty", "employee_id", "monthly_salary_idr"))),
    "w05_salary_rank": with_views(
        """SELECT salary_id, employee_id, monthly_salary_idr,
                  rank() OVER (ORDER BY monthly_salary_idr DESC NULLS FIRST) AS salary_rank FROM salaries""",
        "salaries",
    ),
    "r4_reporting_lines": with_views(
        """, walk AS (
             SELECT employee_id, employee_id AS head, CAST(0 AS BIGINT) AS d, [employee_id] AS path FROM org
             UNION ALL
             SELECT w.employee_id, m.employee_id, d + 1, list_append(path, m.employee_id)
             FROM walk w JOIN org e ON e.employee_id = w.head JOIN org m ON m.employee_id = e.manager_id
             WHERE NOT list_contains(w.path, m.employee_id)),
           last AS (
             SELECT w.*, m.employee_id AS loops FROM walk w JOIN org e ON e.employee_id = w.head
             LEFT JOIN org m ON m.employee_id = e.manager_id
             QUALIFY row_number() OVER (PARTITION BY w.employee_id ORDER BY d DESC) = 1)
           SELECT employee_id, CASE WHEN loops IS NULL THEN d END AS depth, CASE WHEN loops IS NULL THEN head END AS root_id,
                  coalesce(loops = employee_id, false) AS in_cycle FROM last""",
        "employees",
        extra={
            "org": """SELECT employee_id, CASE WHEN employee_id % 100 = 50 THEN employee_id + 1
                             WHEN employee_id % 100 = 51 THEN employee_id - 1
                             WHEN employee_id % 100 BETWEEN 60 AND 89 THEN employee_id + 1 ELSE manager_id END AS manager_id
                      FROM employees"""
        },
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "j10_headcount_by_period": with_views(
        f"""SELECT period_no, period_start, count(*) AS employees, count(DISTINCT dept_id) AS departments
            FROM calendar JOIN employees ON hire_date <= period_end
             AND coalesce(termination_date, DATE '{SNAPSHOT}') >= period_start
             AND hire_date <= coalesce(termination_date, DATE '{SNAPSHOT}')
            GROUP BY ALL""",
        "employees",
        extra={"calendar": CALENDAR},
    ),
    "r3_reviews_due": with_views(
        f"""SELECT employee_id, count(*) AS due, min(period_no) AS first_period, max(period_no) AS last_period
            FROM employees JOIN calendar ON period_end BETWEEN hire_date AND coalesce(termination_date, DATE '{SNAPSHOT}')
            GROUP BY employee_id""",
        "employees",
        extra={"calendar": CALENDAR},
    ),
    "s1_csv_round_trip": with_views(
        """SELECT CAST(employee_id AS VARCHAR) AS employee_id,
                  CASE WHEN employee_id % 10 = 0 THEN full_name || chr(10) || 'second "line"'
                       WHEN employee_id % 10 = 1 THEN full_name || ', "J,r"' ELSE full_name END AS full_name,
                  CASE WHEN employee_id % 13 <> 0 THEN ' ' || city END AS city
           FROM employees""",
        "employees",
    ),
    "c05_date_evidence": _with_raw(
        " UNION ALL ".join([_evidence("hire_date", "raw_employees"), _evidence("termination_date", "raw_employees"), _evidence("us_date", _US)]),
        "employees",
    ),
}
