"""Physical-plan properties: no Python in any plan, size-checked broadcast of
departments, partial top-k before the shuffle, pruned Parquet scans."""

import pytest

from hrlens.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udfs(spark, sf001, name):
    p = plan(QUERIES[name](spark, sf001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_department_join_is_broadcast(spark, sf001):
    p = plan(QUERIES["q01_headcount_by_department"](spark, sf001))
    assert "BroadcastHashJoin" in p


def test_top_k_is_limited_before_shuffle(spark, sf001):
    p = plan(QUERIES["q14_top3_salary_by_department"](spark, sf001))
    assert "WindowGroupLimit" in p


def test_scan_reads_only_needed_columns(spark, sf001):
    df = QUERIES["q03_headcount_by_city_type"](spark, sf001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in p.split("ReadSchema")[1].split("\n")[0]


def test_global_rank_single_partition_only_over_histogram(spark, sf001):
    p = plan(QUERIES["q18_subordinate_counts"](spark, sf001)).split("\n")
    singles = [i for i, line in enumerate(p) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        # The only rows gathered into one partition are the histogram of
        # distinct subordinate counts, never employee rows.
        assert "HashAggregate(keys=[total_subordinates" in p[i + 1]


def test_group_mean_is_an_aggregate_not_a_window(spark, sf001):
    p = plan(QUERIES["q15_salary_vs_peer_average"](spark, sf001))
    assert "Window" not in p and "HashAggregate" in p


def test_salary_lag_windows_per_employee_and_year(spark, sf001):
    p = plan(QUERIES["q16_salary_changes"](spark, sf001))
    window_lines = [line for line in p.split("\n") if "Window [lag(monthly_salary_idr" in line]
    assert window_lines and all("_kk" in line and "_sk" in line for line in window_lines)


def test_filters_reach_the_parquet_scan_on_clean_tables(spark, sf001, tmp_root):
    import os

    from hrlens.operators.degrade import degrade_rows
    from hrlens.plans import analyses as A
    from hrlens.plans.cleaning_run import run_cleaning
    from hrlens.schemas import TABLES
    from hrlens.sources.derive import hr_views
    from hrlens.sources.raw import read_clean_tables
    from hrlens.sources.sinks import write_csv

    raw_dir, out_dir = os.path.join(tmp_root, "pd_raw"), os.path.join(tmp_root, "pd_clean")
    views = hr_views(spark, sf001).as_dict()
    for t in TABLES:
        write_csv(degrade_rows(t, views[t]), os.path.join(raw_dir, t))
    run_cleaning(spark, raw_dir, out_dir, fmt="parquet")
    df = A.headcount_by_department(read_clean_tables(spark, out_dir))
    p = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in p.split("\n") if "FileScan parquet" in line and "employees" in line][0]
    assert "EqualTo(status,Active)" in scan
    # Only the three employee columns the query needs are read.
    assert "ReadSchema: struct<employee_id:bigint,dept_id:bigint,status:string>" in scan
