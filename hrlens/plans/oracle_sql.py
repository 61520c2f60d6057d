"""Cross-check SQL (DuckDB dialect) for the registered queries.

The same five HR views as ``sources.derive`` are rebuilt as CTEs over the
TPC-H-style tables, then each query is written directly in SQL. Rounding uses
the same exact integer half-up formula as ``functions.numeric``.
"""

from __future__ import annotations

from hrlens.schemas import CITIES, LEVELS


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def hu_int(num: str, den: str, digits: int = 0) -> str:
    """round(num/den * 10^digits) half away from zero (BIGINT), NULL on 0."""
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    q = f"((abs({n}) * {2 * 10**digits} + abs({d})) // (2 * abs({d})))"
    return (
        f"CAST(CASE WHEN {d} <> 0 THEN "
        f"CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{q} ELSE {q} END END AS BIGINT)"
    )


def hu_ratio(num: str, den: str, digits: int = 2) -> str:
    scaled = f"CAST({hu_int(num, den, digits)} AS DOUBLE)"
    return scaled if digits == 0 else f"({scaled} / {10**digits}.0)"


def pct(hits: str, total: str, digits: int = 2) -> str:
    return hu_ratio(f"CAST(({hits}) AS HUGEINT) * 100", total, digits)


def as_int(expr: str, digits: int = 0) -> str:
    if digits == 0:
        return f"CAST(round({expr}) AS BIGINT)"
    return f"CAST(round(({expr}) * {10**digits}) AS BIGINT)"


def nano(expr: str) -> str:
    """A measure in 1e-9 units, exactly."""
    return f"CAST(CAST({expr} AS DECIMAL(28,9)) * 1000000000 AS HUGEINT)"


def avg_rounded(expr: str, digits: int) -> str:
    return hu_ratio(f"sum({nano(expr)})", f"count({expr}) * 1000000000", digits)


def finer(tenths: str, key: str) -> str:
    more = f"CASE WHEN {key} % 5 = 0 AND {tenths} < 40 THEN {key} % 97 ELSE 0 END"
    return f"CAST(({tenths} + 10) * 100 + {more} AS DOUBLE) / 1000.0"


K = "c_custkey"

VIEWS = {
    "departments": """
        SELECT CAST(n.n_nationkey AS BIGINT) AS dept_id, n.n_name AS dept_name,
               r.r_name AS division, CAST((n.n_nationkey * 3 + 80) / 2.0 AS DOUBLE) AS salary_band_mid
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "employees": f"""
        SELECT CAST({K} AS BIGINT) AS employee_id,
               c_name AS full_name,
               CASE WHEN {K} % 25 = 0 THEN 'Unknown' WHEN {K} % 2 = 0 THEN 'Male'
                    ELSE 'Female' END AS gender,
               CAST(c_nationkey AS BIGINT) AS dept_id,
               list_extract({_list(LEVELS)}, CAST(({K} // 2) % 7 + 1 AS INTEGER)) AS job_level,
               list_extract({_list(CITIES)}, CAST({K} % 6 + 1 AS INTEGER)) AS city,
               CASE WHEN {K} % 9 = 0 THEN 'Contract' WHEN {K} % 10 = 0 THEN 'Probation'
                    ELSE 'Permanent' END AS employment_type,
               DATE '2012-01-01' + CAST(({K} * 37) % 4700 AS INTEGER) AS hire_date,
               CASE WHEN {K} % 7 = 0 THEN DATE '2012-01-01' + CAST(({K} * 37) % 4700 AS INTEGER)
                    + CAST(30 + ({K} * 13) % 1500 AS INTEGER) END AS termination_date,
               CASE WHEN {K} % 7 = 0 THEN 'Resigned' ELSE 'Active' END AS status,
               ({as_int('c_acctbal', 2)} // 100 + 2000) * 10000 AS monthly_salary_idr,
               CASE WHEN {K} % 12 <> 0 THEN {finer(f'({K} % 41)', K)} END
                    AS satisfaction_score,
               {finer(f'({K} % 31)', K)} AS last_performance_score,
               CASE WHEN {K} <> 0 THEN {K} // 8 END AS manager_id
        FROM customer""",
    "salaries": f"""
        SELECT o_orderkey AS salary_id, o_custkey AS employee_id,
               CAST(o_orderdate AS DATE) AS effective_date,
               {as_int('o_totalprice', 2)} AS monthly_salary_idr,
               CASE WHEN o_orderkey % 20 = 0 THEN 'Unknown' ELSE o_orderpriority END
                    AS change_reason
        FROM orders""",
    "performance_reviews": f"""
        SELECT event_id AS review_id, user_id AS employee_id,
               '2024-P' || CAST(least(4, (dayofmonth(ts) + 7) // 8) AS VARCHAR) AS review_period,
               {finer('(' + as_int('value', 2) + ' % 41)', 'event_id')} AS review_score,
               CASE WHEN user_id // 8 <> 0 THEN user_id // 8 END AS reviewer_id
        FROM events""",
    "goals": f"""
        SELECT l.l_orderkey * 10 + l.l_linenumber AS goal_id, o.o_custkey AS employee_id,
               l.l_returnflag AS goal_title,
               CASE WHEN l.l_linenumber <> 7
                    THEN CAST((({as_int('l.l_quantity')} % 5) * 5 + 20) * 1000 + {as_int('l.l_quantity')} % 3 AS DOUBLE) / 1000.0 END AS weight_pct,
               CAST((({as_int('l.l_discount', 2)} * 10 + {as_int('l.l_quantity')}) % 131) * 1000 + {as_int('l.l_quantity')} % 7 AS DOUBLE) / 1000.0
                    AS achievement_pct,
               '2024' AS period
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
}


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named HR views (and extra CTEs, in order)."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


RESIGNED = "status = 'Resigned'"


def _rate3(prefix: str = "") -> str:
    p = prefix
    return (
        f"count(*) AS headcount, count(*) FILTER (WHERE {p}{RESIGNED}) AS resigned, "
        f"{pct(f'count(*) FILTER (WHERE {p}{RESIGNED})', 'count(*)')} AS attrition_rate"
    )


def _tenure_cte() -> str:
    """Completed years as the difference of the years, less one before the
    day of the year is reached."""
    return """SELECT *, CAST(year(until) - year(hire_date) - CASE WHEN month(until) * 100 + day(until)
                     < month(hire_date) * 100 + day(hire_date) THEN 1 ELSE 0 END AS BIGINT) AS tenure_years
              FROM (SELECT *, coalesce(termination_date, DATE '2025-01-01') AS until FROM employees)"""


BUCKET = """CASE WHEN tenure_years < 1 THEN '0-1 yr' WHEN tenure_years < 3 THEN '1-3 yr'
                 WHEN tenure_years < 5 THEN '3-5 yr' ELSE '5+ yr' END"""


def rolled_up(by: str, src: str = "employees", more: str = "", sat: bool = False) -> str:
    """Attrition in two levels: counts per ``dept_id`` (and ``more``) first,
    summed over ``by`` once the departments are known."""
    average = f", {hu_ratio('sum(points)', 'sum(scored) * 1000000000')} AS avg_satisfaction" if sat else ""
    return f"""
        SELECT {by}, CAST(sum(n) AS BIGINT) AS headcount, CAST(sum(gone) AS BIGINT) AS resigned,
               {pct('sum(gone)', 'sum(n)')} AS attrition_rate{average}
        FROM departments, (SELECT dept_id AS id{more}, sum(1) AS n,
                                  sum(CASE status WHEN 'Resigned' THEN 1 ELSE 0 END) AS gone,
                                  sum({nano('satisfaction_score')}) AS points,
                                  count(satisfaction_score) AS scored
                           FROM {src} GROUP BY ALL)
        WHERE dept_id = id GROUP BY ALL"""


# One scalar count per department, summed over departments of one name.
HEADCOUNT = """
    SELECT dept_name, CAST(sum(heads) AS BIGINT) AS total_employee
    FROM (SELECT dept_name, (SELECT count(*) FROM employees
                             WHERE employees.dept_id = departments.dept_id AND status = 'Active') AS heads
          FROM departments)
    GROUP BY dept_name HAVING sum(heads) > 0"""


def windowed_headcount(columns: str) -> str:
    return f"""SELECT DISTINCT {columns}, count(employee_id) OVER (PARTITION BY city, employment_type) AS total_employee
               FROM employees WHERE status = 'Active'"""


GOALS_PER_EMPLOYEE = f"""
    SELECT employee_id, coalesce({hu_int(f"sum({nano('achievement_pct')} * {nano('weight_pct')})",
                                         f"sum({nano('weight_pct')}) * 1000000000", 6)}, 0) AS micro
    FROM goals GROUP BY employee_id"""

# Sums per dept_id, then per name.
GOAL_ACHIEVEMENT = f"""
    SELECT dept_name, {hu_ratio('sum(total)', 'sum(people) * 1000000', 2)} AS avg_achievement
    FROM departments, (SELECT dept_id AS id, sum(CAST(micro AS HUGEINT)) AS total, count(micro) AS people
                       FROM employees, per_emp WHERE per_emp.employee_id = employees.employee_id
                       GROUP BY dept_id)
    WHERE dept_id = id GROUP BY dept_name"""

ANALYSES_SQL = {
    "headcount_by_department": with_views(HEADCOUNT, "departments", "employees"),
    "avg_salary_by_level": with_views(
        f"""SELECT job_level, {hu_ratio('sum(CAST(monthly_salary_idr AS HUGEINT))', 'count(monthly_salary_idr)', 0)}
                   AS average_salary
            FROM employees WHERE status = 'Active' GROUP BY job_level""",
        "employees",
    ),
    "headcount_by_city_type": with_views(windowed_headcount("city, employment_type"), "employees"),
    "headcount_by_type_city": with_views(windowed_headcount("employment_type, city"), "employees"),
    "attrition_overall": with_views(f"SELECT {_rate3()} FROM employees", "employees"),
    "attrition_by_department": with_views(rolled_up("dept_name"), "departments", "employees"),
    "attrition_vs_satisfaction": with_views(rolled_up("dept_name", sat=True), "departments", "employees"),
    "attrition_by_tenure": with_views(
        rolled_up("dept_name, tenure_bucket", "tenured", f", {BUCKET} AS tenure_bucket", sat=True),
        "departments", "employees", extra={"tenured": _tenure_cte()},
    ),
    "first_year_attrition_by_band": with_views(
        rolled_up(
            "CASE coalesce(salary_band_mid * 1000000 > salary, false) WHEN true THEN 'below band' "
            "ELSE 'at/above band' END AS salary_position",
            "(FROM tenured WHERE tenure_years < 1)", ", monthly_salary_idr AS salary",
        ),
        "departments", "employees", extra={"tenured": _tenure_cte()},
    ),
    "first_year_attrition_by_type": with_views(
        rolled_up("employment_type", "(FROM tenured WHERE tenure_years < 1)", ", employment_type"),
        "departments", "employees", extra={"tenured": _tenure_cte()},
    ),
    "review_trend": with_views(
        f"""SELECT review_period, {avg_rounded('review_score', 2)} AS avg_review_score,
                   round(stddev_samp(review_score), 2) AS score_stddev,
                   round(avg(review_score) - stddev_samp(review_score), 2) AS bottom_limit,
                   round(avg(review_score) + stddev_samp(review_score), 2) AS upper_limit
            FROM performance_reviews GROUP BY review_period""",
        "performance_reviews",
    ),
    "goal_achievement_by_department": with_views(
        GOAL_ACHIEVEMENT, "departments", "employees", "goals", extra={"per_emp": GOALS_PER_EMPLOYEE}
    ),
    "gender_pay_gap_by_level": with_views(
        f"""SELECT job_level, CAST(ma AS DOUBLE) AS avg_male, CAST(mb AS DOUBLE) AS avg_female,
                   CAST(gap AS DOUBLE) AS pay_gap,
                   CASE WHEN dir = 'Higher for Male' THEN {hu_ratio('abs(gap) * 100', 'ma', 2)}
                        WHEN dir = 'Higher for Female' THEN {hu_ratio('abs(gap) * 100', 'mb', 2)}
                        ELSE 0.0 END AS pay_gap_pct,
                   dir AS gap_direction
            FROM (SELECT job_level, {hu_int('sa', 'na', 0)} AS ma, {hu_int('sb', 'nb', 0)} AS mb,
                         CASE WHEN na > 0 AND nb > 0 THEN {hu_int('sa * nb - sb * na', 'na * nb', 0)} END AS gap,
                         CASE WHEN na > 0 AND nb > 0 AND sa * nb - sb * na > 0 THEN 'Higher for Male'
                              WHEN na > 0 AND nb > 0 AND sa * nb - sb * na < 0 THEN 'Higher for Female'
                              ELSE 'Equal' END AS dir
                  FROM (SELECT job_level,
                               sum(CAST(monthly_salary_idr AS HUGEINT)) FILTER (WHERE gender = 'Male') AS sa,
                               CAST(count(monthly_salary_idr) FILTER (WHERE gender = 'Male') AS HUGEINT) AS na,
                               sum(CAST(monthly_salary_idr AS HUGEINT)) FILTER (WHERE gender = 'Female') AS sb,
                               CAST(count(monthly_salary_idr) FILTER (WHERE gender = 'Female') AS HUGEINT) AS nb
                        FROM employees WHERE gender IN ('Male', 'Female')
                        GROUP BY job_level))""",
        "employees",
    ),
    # The rank is one more than the number of larger salaries (unknown ones are largest).
    "top3_salary_by_department": with_views(
        """SELECT dept_name, salary_rank, full_name, monthly_salary_idr
           FROM departments, (SELECT dept_id AS id, full_name, monthly_salary_idr,
                                     1 + (SELECT count(*) FROM employees AS other
                                          WHERE other.dept_id = one.dept_id
                                            AND coalesce(other.monthly_salary_idr, 9223372036854775807)
                                                > coalesce(one.monthly_salary_idr, 9223372036854775807)) AS salary_rank
                              FROM employees AS one)
           WHERE dept_id = id AND salary_rank < 4""",
        "departments", "employees",
    ),
    "salary_vs_peer_average": with_views(
        f"""SELECT d.dept_name, g.job_level, g.full_name, g.monthly_salary_idr,
                   CAST(g.a AS DOUBLE) AS avg_dept_salary,
                   CAST(g.monthly_salary_idr - g.a AS DOUBLE) AS pay_gap,
                   {hu_ratio('(g.monthly_salary_idr - g.a) * 100', 'g.a', 2)} AS pay_gap_pct
            FROM (SELECT full_name, dept_id, job_level, monthly_salary_idr,
                         {hu_int('sum(CAST(monthly_salary_idr AS HUGEINT)) OVER w', 'count(monthly_salary_idr) OVER w', 0)} AS a
                  FROM employees WINDOW w AS (PARTITION BY dept_id, job_level)) g
            JOIN departments d ON d.dept_id = g.dept_id""",
        "departments", "employees",
    ),
    # Each history as one sorted list; the previous salary is the entry before.
    "salary_changes": with_views(
        """SELECT full_name, h[i].d AS effective_date, h[i].s AS current_salary,
                  CASE WHEN i > 1 THEN h[i - 1].s END AS prev_salary,
                  CASE WHEN i > 1 THEN h[i].s - h[i - 1].s END AS salary_change, h[i].r AS change_reason
           FROM employees, (SELECT employee_id AS id, h, unnest(range(1, len(h) + 1)) AS i FROM histories)
           WHERE employee_id = id""",
        "employees", "salaries",
        extra={"histories": """SELECT employee_id, list({'d': effective_date, 's': monthly_salary_idr, 'r': change_reason}
                                      ORDER BY effective_date ASC NULLS LAST, salary_id ASC NULLS LAST) AS h
                               FROM salaries GROUP BY employee_id"""},
    ),
    # Department and manager are looked up one by one; nothing is joined.
    "org_structure": with_views(
        """SELECT employee_id, full_name, gender, names[dept_id] AS dept_name, job_level, up.id AS manager_id,
                  up.name AS manager_name, up.gender AS manager_gender, names[up.dept] AS manager_department,
                  up.level AS manager_level
           FROM (SELECT *, (SELECT map_from_entries(list((dept_id, dept_name))) FROM departments) AS names,
                        (SELECT any_value({'id': x.employee_id, 'name': x.full_name, 'gender': x.gender,
                                           'dept': x.dept_id, 'level': x.job_level, 'status': x.status})
                         FROM employees AS x WHERE x.employee_id = employees.manager_id) AS up
                 FROM employees)
           WHERE status = 'Active' AND dept_id IN (SELECT dept_id FROM departments)
             AND coalesce(up.status, 'Active') = 'Active'""",
        "departments", "employees",
    ),
    # A scalar count for each manager; the rank is one more than the number of larger counts.
    "subordinate_counts": with_views(
        """SELECT full_name, dept_name, total_subordinates,
                  1 + (SELECT coalesce(CAST(sum(people) AS BIGINT), 0) FROM sizes
                       WHERE sizes.total_subordinates > counted.total_subordinates) AS rank_by_subordinates
           FROM counted""",
        "departments", "employees",
        extra={
            "counted": """SELECT full_name, dept_name,
                                 (SELECT count(*) FROM employees AS x
                                  WHERE x.status = 'Active' AND x.manager_id = employees.employee_id) AS total_subordinates
                          FROM employees NATURAL JOIN (SELECT dept_id, dept_name FROM departments)
                          WHERE status = 'Active'""",
            "sizes": "SELECT total_subordinates, count(*) AS people FROM counted GROUP BY 1",
        },
    ),
}
