"""Every registered query against its DuckDB cross-check on the smallest
data set (the driver repeats this at sf0.01)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from hrlens.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
QUERIES = registry.queries()
SQL = registry.oracle_sql()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def duck(sf001):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf001, name):
    df = QUERIES[name](spark, sf001)
    cols = df.columns
    ours = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=_key)
    cur = duck.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    assert ours == theirs


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["dept_name", "tenure_bucket", "headcount", "resigned", "attrition_rate", "avg_satisfaction"]
    assert df.count() > 0


@pytest.fixture
def no_broadcast(spark):
    """The cluster case: Spark's automatic broadcast is off, so the shuffle-join fallbacks run."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_without_broadcasts(spark, duck, sf001, no_broadcast, name):
    test_query_matches_sql(spark, duck, sf001, name)
