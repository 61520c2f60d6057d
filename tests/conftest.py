import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from hrlens.schemas import clean_schema  # noqa: E402
from hrlens.session import get_session  # noqa: E402
from hrlens.sources.derive import HRTables  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="hrlens-test-")
    s = get_session(
        "local[4]",
        shuffle_partitions=8,
        conf={
            "spark.sql.warehouse.dir": os.path.join(tmp, "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_root():
    return tempfile.mkdtemp(prefix="hrlens-run-")


@pytest.fixture(scope="session")
def sf001():
    return os.path.join(DATA, "sf0.001")


@pytest.fixture(scope="session")
def sf01():
    return os.path.join(DATA, "sf0.01")


D = dt.date

EMPLOYEES = [
    # id, name, gender, dept, level, city, type, hire, term, status, salary, sat, perf, manager
    (1, "Ana", "Female", 1, "Head", "Jakarta", "Permanent", D(2015, 3, 1), None, "Active", 70_000_000, 4.0, 4.5, None),
    (2, "Budi", "Male", 1, "Manager", "Jakarta", "Permanent", D(2016, 1, 10), None, "Active", 50_000_000, 3.5, 4.0, 1),
    (3, "Citra", "Female", 1, "Senior", "Bandung", "Contract", D(2024, 6, 1), None, "Active", 30_000_000, None, 3.0, 2),
    (4, "Dewi", "Female", 1, "Senior", "Bandung", "Permanent", D(2020, 2, 29), D(2021, 2, 28), "Resigned", 30_000_000, 2.0, 2.5, 2),
    (5, "Eko", "Male", 2, "Head", "Remote", "Permanent", D(2018, 5, 5), None, "Active", 60_000_000, 3.0, 3.0, None),
    (6, "Fajar", "Male", 2, "Intern", "Remote", "Probation", D(2024, 9, 1), None, "Active", None, 3.0, 3.0, 5),
    (7, "Gita", "Female", 2, "Intern", "Remote", "Contract", D(2024, 8, 1), D(2024, 12, 1), "Resigned", 8_000_000, 3.0, 3.0, 5),
    (8, "Hadi", "Male", 2, "Mid", "Medan", "Permanent", D(2019, 1, 1), None, "Active", 20_000_000, 3.3, 3.3, 9),
    (9, "Indra", "Male", 2, "Manager", "Medan", "Permanent", D(2017, 1, 1), D(2023, 1, 1), "Resigned", 45_000_000, 3.1, 3.1, 5),
    (10, "Joko", "Male", 1, "Lead", "Jakarta", "Permanent", D(2019, 7, 7), None, "Active", 50_000_000, 3.9, 3.9, 777),
    (11, "Kiki", "Unknown", 1, "Lead", "Jakarta", "Permanent", D(2019, 7, 7), None, "Active", 50_000_000, 3.9, 3.9, 1),
]

DEPARTMENTS = [(1, "Engineering", "Technology", 28.0), (2, "Sales", "Commercial", 20.0)]

SALARIES = [
    (1, 1, D(2015, 3, 1), 60_000_000, "Initial"),
    (2, 1, D(2018, 3, 1), 65_000_000, "Annual Raise"),
    (3, 1, D(2021, 3, 1), 70_000_000, "Promotion"),
    (4, 2, D(2016, 1, 10), 52_000_000, "Initial"),
    (5, 2, D(2016, 1, 10), 50_000_000, "Adjustment"),  # same-day tie: salary_id orders it
]

REVIEWS = [
    (1, 1, "2024-H1", 4.0, None),
    (2, 1, "2024-H2", 4.5, None),
    (3, 2, "2024-H1", 3.0, 1),
    (4, 2, "2024-H2", 3.5, 1),
    (5, 5, "2024-H2", 3.5, None),
]

GOALS = [
    (1, 1, "A", None, 80.0, "2024"),  # all weights NULL -> 0
    (2, 1, "B", None, 90.0, "2024"),
    (3, 2, "A", 50.0, 100.0, "2024"),
    (4, 2, "B", 50.0, None, "2024"),  # NULL achievement: only the numerator skips it
    (5, 5, "A", 20.0, 85.0, "2024"),
    (6, 5, "B", 30.0, 95.0, "2024"),
]


@pytest.fixture(scope="session")
def hr(spark):
    def df(rows, table):
        return spark.createDataFrame(rows, clean_schema(table))

    return HRTables(
        departments=df(DEPARTMENTS, "departments"),
        employees=df(EMPLOYEES, "employees"),
        salaries=df(SALARIES, "salaries"),
        performance_reviews=df(REVIEWS, "performance_reviews"),
        goals=df(GOALS, "goals"),
    )
