"""Hand-built five-table fixture covering the semantics traps of the analyses."""

import datetime as dt

from hrlens.plans import analyses as A


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_q14_ties_kept_and_null_salary_ranks_first(hr):
    got = rows(A.top3_salary_by_department(hr), "dept_name", "salary_rank", "full_name", "monthly_salary_idr")
    assert got == sorted([
        ("Engineering", 1, "Ana", 70_000_000),
        ("Engineering", 2, "Budi", 50_000_000),
        ("Engineering", 2, "Joko", 50_000_000),
        ("Engineering", 2, "Kiki", 50_000_000),
        ("Sales", 1, "Fajar", None),
        ("Sales", 2, "Eko", 60_000_000),
        ("Sales", 3, "Indra", 45_000_000),
    ], key=lambda r: (r[0], r[1], r[2]))


def test_q13_one_gender_level_is_equal(hr):
    got = {r.job_level: r for r in A.gender_pay_gap_by_level(hr).collect()}
    intern = got["Intern"]
    assert intern.avg_male is None and intern.avg_female == 8_000_000.0
    assert intern.pay_gap is None and intern.pay_gap_pct == 0.0 and intern.gap_direction == "Equal"
    head = got["Head"]
    assert (head.avg_male, head.avg_female, head.pay_gap) == (60_000_000.0, 70_000_000.0, -10_000_000.0)
    assert head.gap_direction == "Higher for Female" and head.pay_gap_pct == 14.29
    assert got["Manager"].avg_male == 47_500_000.0 and got["Manager"].gap_direction == "Equal"
    assert "Lead" in got and got["Lead"].avg_female is None  # Unknown gender excluded


def test_q17_resigned_manager_drops_dangling_manager_stays(hr):
    got = {r.employee_id: r for r in A.org_structure(hr).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 10, 11]
    assert got[10].manager_id is None and got[10].manager_name is None
    assert got[3].manager_name == "Budi" and got[3].manager_department == "Engineering"


def test_q18_zero_reports_kept_and_ranked(hr):
    got = {r.full_name: (r.total_subordinates, r.rank_by_subordinates) for r in A.subordinate_counts(hr).collect()}
    assert got == {
        "Ana": (2, 1), "Budi": (1, 2), "Eko": (1, 2), "Citra": (0, 4),
        "Fajar": (0, 4), "Hadi": (0, 4), "Joko": (0, 4), "Kiki": (0, 4),
    }


def test_q08_leap_day_tenure_is_zero(hr):
    got = {(r.dept_name, r.tenure_bucket): r for r in A.attrition_by_tenure(hr).collect()}
    first = got[("Engineering", "0-1 yr")]
    assert (first.headcount, first.resigned, first.attrition_rate) == (2, 1, 50.0)
    assert first.avg_satisfaction == 2.0  # Citra's NULL satisfaction is skipped


def test_q09_null_salary_falls_to_else(hr):
    got = {r.salary_position: (r.headcount, r.resigned, r.attrition_rate) for r in A.first_year_attrition_by_band(hr).collect()}
    assert got == {"at/above band": (3, 1, 33.33), "below band": (1, 1, 100.0)}


def test_q11_mean_and_sample_stddev(hr):
    got = {r.review_period: r for r in A.review_trend(hr).collect()}
    h1, h2 = got["2024-H1"], got["2024-H2"]
    assert (h1.avg_review_score, h1.score_stddev, h1.bottom_limit, h1.upper_limit) == (3.5, 0.71, 2.79, 4.21)
    assert (h2.avg_review_score, h2.score_stddev, h2.bottom_limit, h2.upper_limit) == (3.83, 0.58, 3.26, 4.41)


def test_q12_weighted_mean_null_rules(hr):
    got = {r.dept_name: r.avg_achievement for r in A.goal_achievement_by_department(hr).collect()}
    assert got == {"Engineering": 25.0, "Sales": 91.0}


def test_q16_lag_with_same_day_tie(hr):
    got = rows(A.salary_changes(hr), "full_name", "effective_date", "current_salary", "prev_salary", "salary_change")
    assert got == sorted([
        ("Ana", dt.date(2015, 3, 1), 60_000_000, None, None),
        ("Ana", dt.date(2018, 3, 1), 65_000_000, 60_000_000, 5_000_000),
        ("Ana", dt.date(2021, 3, 1), 70_000_000, 65_000_000, 5_000_000),
        ("Budi", dt.date(2016, 1, 10), 52_000_000, None, None),
        ("Budi", dt.date(2016, 1, 10), 50_000_000, 52_000_000, -2_000_000),
    ], key=lambda r: (r[0], r[1], r[2]))


def test_q05_overall_and_empty_input(hr):
    r = A.attrition_overall(hr).first()
    assert (r.headcount, r.resigned, r.attrition_rate) == (11, 3, 27.27)
    empty = hr.__class__(**{**hr.as_dict(), "employees": hr.employees.limit(0)})
    r = A.attrition_overall(empty).first()
    assert (r.headcount, r.resigned, r.attrition_rate) == (0, 0, None)


def test_q15_peer_average_rounded_before_gap(hr):
    got = {r.full_name: r for r in A.salary_vs_peer_average(hr).collect()}
    # Sales / Intern: Fajar NULL and Gita 8M -> mean 8M; NULL salary keeps NULL gap.
    assert got["Gita"].avg_dept_salary == 8_000_000.0 and got["Gita"].pay_gap == 0.0
    assert got["Fajar"].pay_gap is None
    # Engineering / Lead: Joko and Kiki 50M.
    assert got["Joko"].pay_gap_pct == 0.0


def test_ordered_applies_postgres_null_order(hr):
    df = A.ordered("top3_salary_by_department", A.top3_salary_by_department(hr))
    names = [r.full_name for r in df.collect()]
    assert names[0] == "Ana" and names[-3] == "Fajar"


def test_q08_unknown_tenure_falls_to_last_bucket(spark, hr):
    from pyspark.sql import functions as F

    # Citra (Engineering, hired 2024) is first-year; without a hire date her
    # tenure is unknown, which CASE sends to the last bucket.
    emp = hr.employees.withColumn(
        "hire_date", F.when(F.col("employee_id") == 3, F.lit(None).cast("date")).otherwise(F.col("hire_date"))
    )
    t = hr.__class__(**{**hr.as_dict(), "employees": emp})
    got = {(r.dept_name, r.tenure_bucket): r.headcount for r in A.attrition_by_tenure(t).collect()}
    assert got[("Engineering", "0-1 yr")] == 1 and got[("Engineering", "5+ yr")] == 5
    first = {r.salary_position: r.headcount for r in A.first_year_attrition_by_band(t).collect()}
    assert sum(first.values()) == 3


def test_every_presentation_order_applies(hr):
    for name, (fn, order) in A.ANALYSES.items():
        rows = A.ordered(name, fn(hr)).collect()
        if name == "gender_pay_gap_by_level":
            gaps = [abs(r.pay_gap) for r in rows if r.pay_gap is not None]
            assert gaps == sorted(gaps, reverse=True)
            assert rows[0].pay_gap is None  # NULL first when descending
        assert rows is not None, name


def test_scale_conf_sizes_partitions():
    from hrlens.session import scale_conf

    small = scale_conf(10 << 30, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 128  # floor of 2x cores
    big = scale_conf(100 << 40, total_cores=8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 409_600  # 256 MB each, at any size
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
