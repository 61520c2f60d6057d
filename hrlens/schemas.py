"""Table schemas and the fixed domain values the analyses depend on."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# --------------------------------------------------------------------------- #
# Fixed values (must equal the source project's for identical results)
# --------------------------------------------------------------------------- #
# Snapshot date of the data set ("today" for tenure).
SNAPSHOT = _dt.date(2025, 1, 1)

# Job levels, lowest to highest, with the salary multiplier on the
# department band midpoint.
LEVELS = ["Intern", "Junior", "Mid", "Senior", "Lead", "Manager", "Head"]
LEVEL_MULTIPLIER = {
    "Intern": 0.35,
    "Junior": 0.70,
    "Mid": 1.00,
    "Senior": 1.45,
    "Lead": 1.90,
    "Manager": 2.40,
    "Head": 3.20,
}

# Divisions departments belong to.
DIVISIONS = ["Technology", "Commercial", "Operations"]

# Work locations.
CITIES = ["Jakarta", "Bandung", "Surabaya", "Yogyakarta", "Medan", "Remote"]

# Employment types.
EMPLOYMENT_TYPES = ["Permanent", "Contract", "Probation"]

# Raw gender labels (lower-cased, trimmed) -> canonical label; others -> NULL.
GENDER_MAP = {
    "male": "Male",
    "m": "Male",
    "l": "Male",
    "female": "Female",
    "f": "Female",
    "p": "Female",
}
GENDER_DOMAIN = ["Male", "Female", "Unknown"]

# Date formats tried in this order; the first that parses wins.
# Python strptime spelling: %Y-%m-%d, %d/%m/%Y, %m/%d/%Y, %d-%m-%Y.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy"]

# Category columns where a missing value becomes this label.
UNKNOWN = "Unknown"

# Semi-annual review periods and their closing dates.
REVIEW_PERIODS = [
    ("2023-H1", _dt.date(2023, 6, 30)),
    ("2023-H2", _dt.date(2023, 12, 31)),
    ("2024-H1", _dt.date(2024, 6, 30)),
    ("2024-H2", _dt.date(2024, 12, 31)),
]

# Tenure buckets: (upper bound exclusive, label); the last label is the ELSE.
TENURE_BUCKETS = [(1, "0-1 yr"), (3, "1-3 yr"), (5, "3-5 yr")]
TENURE_ELSE = "5+ yr"

# Salary position against the department band midpoint (band is in millions).
BELOW_BAND = "below band"
AT_OR_ABOVE_BAND = "at/above band"
BAND_UNIT = 1_000_000

# Gap direction labels.
HIGHER_MALE = "Higher for Male"
HIGHER_FEMALE = "Higher for Female"
EQUAL = "Equal"

# Attrition risk model: base, satisfaction pivot and weight, pay-gap weight,
# short-tenure threshold (years) and bump, low-performance threshold and bump,
# intern bump, clip range.
RISK_BASE = 0.16
RISK_SAT_PIVOT = 3.5
RISK_SAT_WEIGHT = 0.08
RISK_PAY_WEIGHT = 0.30
RISK_SHORT_TENURE_YEARS = 1.5
RISK_SHORT_TENURE_BUMP = 0.08
RISK_LOW_PERF = 2.8
RISK_LOW_PERF_BUMP = 0.10
RISK_INTERN_BUMP = 0.06
RISK_MIN = 0.03
RISK_MAX = 0.80

# Tokens pandas' CSV reader treats as missing by default (public pandas
# behaviour); the raw reader maps them to NULL.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --------------------------------------------------------------------------- #
# Raw (all string) and clean (typed) schemas
# --------------------------------------------------------------------------- #
TABLE_COLUMNS = {
    "departments": ["dept_id", "dept_name", "division", "salary_band_mid"],
    "employees": [
        "employee_id", "full_name", "gender", "dept_id", "job_level", "city",
        "employment_type", "hire_date", "termination_date", "status",
        "monthly_salary_idr", "satisfaction_score", "last_performance_score",
        "manager_id",
    ],
    "salaries": [
        "salary_id", "employee_id", "effective_date", "monthly_salary_idr",
        "change_reason",
    ],
    "performance_reviews": [
        "review_id", "employee_id", "review_period", "review_score",
        "reviewer_id",
    ],
    "goals": [
        "goal_id", "employee_id", "goal_title", "weight_pct",
        "achievement_pct", "period",
    ],
}

TABLES = list(TABLE_COLUMNS)


def raw_schema(table: str) -> T.StructType:
    """Every column as STRING: raw exports are read untyped on purpose."""
    return T.StructType(
        [T.StructField(c, T.StringType(), True) for c in TABLE_COLUMNS[table]]
    )


_L, _S, _D, _F = T.LongType(), T.StringType(), T.DateType(), T.DoubleType()

CLEAN_TYPES = {
    "departments": [_L, _S, _S, _F],
    "employees": [_L, _S, _S, _L, _S, _S, _S, _D, _D, _S, _L, _F, _F, _L],
    "salaries": [_L, _L, _D, _L, _S],
    "performance_reviews": [_L, _L, _S, _F, _L],
    "goals": [_L, _L, _S, _F, _F, _S],
}


def clean_schema(table: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c, t, True)
            for c, t in zip(TABLE_COLUMNS[table], CLEAN_TYPES[table])
        ]
    )
