"""CSV files read in splits, publishing in versions, reporting lines, interval
joins, tagged foreign keys and date evidence."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrlens.operators import quality as V
from hrlens.operators.degrade import degrade_rows
from hrlens.operators.date_evidence import date_evidence, parse_dates_by_evidence
from hrlens.operators.intervals import containing, overlapping
from hrlens.operators.lines import reporting_lines
from hrlens.plans import cleaning_run
from hrlens.sources import versions
from hrlens.sources.derive import hr_views
from hrlens.sources.raw import quoted_breaks, read_clean_tables, read_csv
from hrlens.sources.sinks import write_csv

PAIR = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- CSV -------------------------------------------------------------------


def test_plain_files_are_read_in_splits(spark, tmp_path):
    """One file of some MB is read by many tasks, with the rows of a read by one."""
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        f.write("a,b\n")
        for i in range(120_000):
            f.write(f'{i},"say ""hi"", {i}"\n' if i % 3 else f"{i},plain {i}\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        df = read_csv(spark, str(path), PAIR)
        assert df.rdd.getNumPartitions() > 4
        whole = read_csv(spark, str(path), PAIR, multi_line=True)
        assert whole.rdd.getNumPartitions() == 1
        assert df.count() == 120_000 and df.exceptAll(whole).count() == 0
    finally:
        spark.conf.set(key, before)


def test_files_with_quoted_breaks_are_converted(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "one.csv").write_text('a,b\n1,"two\nlines"\n2,"a ""quote""\n, comma"\n')
    (folder / "two.csv").write_text('b,a\n"x, y",3\n,4\n')
    (folder / "three.csv").write_text('a,b\r\n5,"win"\r\n')
    (folder / "stray.csv").write_text('a,b\n6,5" pipe\n')
    (folder / "head.csv").write_text("a,b\n")
    breaks = {os.path.basename(r.file): r.breaks for r in quoted_breaks(spark, str(folder)).collect()}
    assert breaks == {"one.csv": True, "two.csv": False, "three.csv": False, "stray.csv": True, "head.csv": False}
    del breaks
    (folder / "two.csv").write_text('a,b\n3,"x, y"\n4,\n')
    want = [("1", "two\nlines"), ("2", 'a "quote"\n, comma'), ("3", "x, y"), ("4", None), ("5", "win"), ("6", '5" pipe')]
    assert sorted(rows(read_csv(spark, str(folder), PAIR))) == want
    assert sorted(rows(read_csv(spark, str(folder), PAIR, multi_line=True))) == want


def test_csv_round_trip_with_breaks(spark, tmp_path):
    data = [(str(i), f'line {i}\nnext "{i}", end' if i % 5 == 0 else f" padded {i} ") for i in range(200)]
    df = spark.createDataFrame(data, PAIR)
    path = write_csv(df.repartition(4, F.col("a").cast("int") % 5 == 0), str(tmp_path / "out"))
    assert rows(read_csv(spark, path, PAIR)) == sorted(data)


# --- versions --------------------------------------------------------------


def test_killed_publish_leaves_the_old_set(spark, sf001, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "clean")
    for t, df in hr_views(spark, sf001).as_dict().items():
        write_csv(degrade_rows(t, df), f"{raw}/{t}")
    cleaning_run.run_cleaning(spark, raw, out, fmt="parquet", versioned=True)
    first = versions.current(spark, out)
    before = {k: df.count() for k, df in read_clean_tables(spark, out).as_dict().items()}
    assert before["employees"] > 0

    write, n = versions.write_table, []

    def killed(df, *args):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt("killed between two tables")
        return write(df.limit(1), *args)

    monkeypatch.setattr(versions, "write_table", killed)
    with pytest.raises(KeyboardInterrupt):
        cleaning_run.run_cleaning(spark, raw, out, fmt="parquet", versioned=True)
    assert versions.current(spark, out) == first
    assert {k: df.count() for k, df in read_clean_tables(spark, out).as_dict().items()} == before
    monkeypatch.setattr(versions, "write_table", write)

    cleaning_run.run_cleaning(spark, raw, out, fmt="parquet", versioned=True)
    second = versions.current(spark, out)
    assert second != first and len(versions.versions(spark, out)) == 3
    versions.drop_old(spark, out, keep=1)
    assert [second.rsplit("/", 1)[-1]] == versions.versions(spark, out)
    assert {k: df.count() for k, df in read_clean_tables(spark, out).as_dict().items()} == before


def test_a_folder_without_pointer_is_itself(spark, tmp_path):
    assert versions.current(spark, str(tmp_path)) == str(tmp_path)
    assert versions.versions(spark, str(tmp_path)) == []


# --- reporting lines -------------------------------------------------------


def brute_lines(people):
    out = {}
    for e in people:
        path, at = [e], people[e]
        while at in people and at not in path:
            path.append(at)
            at = people[at]
        out[e] = (None, None, at == e) if at in people else (len(path) - 1, path[-1], False)
    return sorted((e, *x) for e, x in out.items())


def test_reporting_lines(spark):
    """A long chain, trees, a self-manager, cycles with tails, a dangling
    manager, a null id, and a manager of a third of all."""
    people = {i: i - 1 for i in range(1, 150)} | {0: None}
    people |= {200: 200, 201: 202, 202: 203, 203: 201, 204: 203, 205: 204, 206: 205, 300: 999_999, 301: 300}
    people |= {i: 7 for i in range(400, 480)}
    data = [*people.items(), (None, 3), (301, 300)]
    df = spark.createDataFrame(data, "employee_id long, manager_id long")
    got = sorted((tuple(r) for r in reporting_lines(df).collect()), key=lambda r: r[0])
    assert got == brute_lines(people)
    assert reporting_lines(df.limit(0)).collect() == []


# --- intervals -------------------------------------------------------------


@pytest.mark.parametrize("bin_days", [1, 30, 365, 100_000])
def test_interval_joins(spark, bin_days):
    d = "date'2020-01-01'"
    spans = spark.range(80).selectExpr("id s", f"date_add({d}, int(id * 37 % 400)) a", f"date_add({d}, int(id * 37 % 400 + id * 13 % 90 - 3)) b")
    spans = spans.unionByName(spark.sql(f"select 900L s, cast(null as date) a, {d} b union all select 901L, {d}, {d}")).unionByName(spans.limit(3))
    periods = spark.range(60).selectExpr("id p", f"date_add({d}, int(id * 9)) c", f"date_add({d}, int(id * 9 + id % 20)) e")
    want = spans.crossJoin(periods).where("a <= b and a <= e and c <= b").select("s", "p")
    assert rows(overlapping(spans, "a", "b", periods, "c", "e", bin_days).select("s", "p")) == rows(want)
    want = spans.crossJoin(periods).where("a <= e and e <= b").select("s", "p")
    got = containing(spans, "a", "b", periods.drop("c"), "e", bin_days)
    assert rows(got.select("s", "p")) == rows(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert overlapping(spans.limit(0), "a", "b", periods, "c", "e").count() == 0


# --- foreign keys ----------------------------------------------------------


def test_tagged_foreign_keys(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    one = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    two = spark.createDataFrame([(3,), (4,), (2,)], "y long")
    got = V.foreign_keys([(one, "one", "x"), (two, "two", "y")], parent, "p", "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    single = V.foreign_key(one, "one", "x", parent, "p", "id").unionByName(V.foreign_key(two, "two", "y", parent, "p", "id"))
    assert rows(got) == rows(single) and got.count() == 3
    assert V.foreign_keys([(one.limit(0), "one", "x")], parent.limit(0), "p", "id").count() == 0


# --- date evidence ---------------------------------------------------------


def test_date_evidence_decides_ambiguous_dates(spark):
    data = [("04/25/2021", "25/04/2021"), ("05/04/2021", "05/04/2021"), ("2021-01-02", "x"), (None, " "), ("12-05-2021", "13/13/2021")]
    df = spark.createDataFrame(data, "us string, eu string")
    got = {r.column_name: r.asDict() for r in date_evidence(df, ["us", "eu"]).collect()}
    assert got["us"] == {"column_name": "us", "day_first_only": 0, "month_first_only": 1, "either": 1, "other_format": 2, "unread": 1, "chosen": "month_first"}
    assert got["eu"] == {"column_name": "eu", "day_first_only": 1, "month_first_only": 0, "either": 1, "other_format": 0, "unread": 3, "chosen": "day_first"}
    parsed = [(str(r.us), str(r.eu)) for r in parse_dates_by_evidence(df, ["us", "eu"]).collect()]
    assert parsed == [("2021-04-25", "2021-04-25"), ("2021-05-04", "2021-04-05"), ("2021-01-02", "None"), ("None", "None"), ("2021-05-12", "None")]
    assert [r.chosen for r in date_evidence(df.limit(0), ["us"]).collect()] == ["day_first"]
