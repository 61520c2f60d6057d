import datetime as dt

import pytest
from pyspark.sql import functions as F

from hrlens.functions import parse, text
from hrlens.functions.dates import completed_years
from hrlens.functions.numeric import half_up_int, half_up_ratio, pct


def _apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_text(spark):
    got = _apply(spark, text.clean_text, ["a  b", " a  b ", "\tx  y ", None])
    assert got == ["a b", "a b", "x y", None]


def test_title_case_matches_python(spark):
    values = ["o'NEIL putri-ayu, s.PD KH. m.farm", "3rd street", "ÉLAN vital", ""]
    assert _apply(spark, text.title_case, values) == [v.title() for v in values]


def test_normalise_label(spark):
    assert _apply(spark, text.normalise_label, [" active", "RESIGNED ", None]) == ["Active", "Resigned", None]


def test_canonical_gender(spark):
    got = _apply(spark, parse.canonical_gender, ["m", " L ", "P", "Female", "x", "", None])
    assert got == ["Male", "Male", "Female", "Female", None, None, None]


def test_parse_date_multi(spark):
    d = dt.date(2021, 4, 17)
    values = ["2021-04-17", "17/04/2021", "04/17/2021", "17-04-2021", "05/04/2021", " 5/4/2021 ",
              "30/02/2021", "", None, "17/04/21", "17/04/2021 10:00"]
    expected = [d, d, d, d, dt.date(2021, 4, 5), dt.date(2021, 4, 5), None, None, None, None, None]
    assert _apply(spark, parse.parse_date_multi, values) == expected


def test_ambiguous_dates(spark):
    got = _apply(spark, parse.is_ambiguous_date, ["05/04/2021", "17/04/2021", "2021-04-05", None])
    assert got == [True, False, False, False]


def test_parse_currency(spark):
    got = _apply(spark, parse.parse_currency, ["Rp30.100.000", "30100000 ", "30100000", "Rp1,000", "abc", None, "1234.0"])
    assert got == [30100000, 30100000, 30100000, 1000, None, None, 12340]


def test_to_int(spark):
    got = _apply(spark, parse.to_int, ["1234.0", "30100000 ", "12.5", "abc", "Rp1,000", None, "9007199254740993"])
    assert got == [1234, 30100000, None, None, None, None, 9007199254740993]


def test_parse_percent(spark):
    assert _apply(spark, parse.parse_percent, ["85%", "85.0", " 7 % ", "nan", "x", None]) == [85.0, 85.0, 7.0, None, None, None]


def test_to_number_nan_is_null(spark):
    assert _apply(spark, parse.to_number, ["3.5", " 4 ", "NaN", "x"]) == [3.5, 4.0, None, None]


def test_completed_years(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 2, 29), dt.date(2021, 2, 28)), (dt.date(2020, 2, 29), dt.date(2021, 3, 1)),
         (dt.date(2021, 1, 1), dt.date(2020, 1, 1))],
        "a date, b date",
    )
    assert [r[0] for r in df.select(completed_years(F.col("a"), F.col("b"))).collect()] == [0, 1, -1]


@pytest.mark.parametrize(
    "num,den,digits,expected",
    [(1, 8, 2, 0.13), (-1, 8, 2, -0.13), (1005, 1000, 2, 1.01), (5, 2, 0, 3.0), (-5, 2, 0, -3.0), (1, 0, 2, None)],
)
def test_half_up_ratio(spark, num, den, digits, expected):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    assert df.select(half_up_ratio(F.col("n"), F.col("d"), digits)).first()[0] == expected


def test_pct_and_int(spark):
    df = spark.createDataFrame([(1, 3)], "n long, d long")
    r = df.select(pct(F.col("n"), F.col("d")), half_up_int(F.col("n"), F.col("d"), 4)).first()
    assert r[0] == 33.33 and r[1] == 3333


def test_date_shapes_keep_every_text_that_a_format_reads(spark):
    """The shapes only spare parses that fail."""
    from pyspark.sql import functions as F

    from hrlens.functions import parse
    from hrlens.schemas import DATE_FORMATS

    parts = ["", "0", "1", "2", "007", "12", "13", "31", "99", "+1", "-1", "0002", "2020", "02020", "+12345", "-2020", "１", " 1", "x"]
    texts = [f"{a}{s}{b}{u}{c}" for a in parts for b in parts for c in parts for s, u in (("-", "-"), ("/", "/"), ("/", "-"))]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "2020-01-02 ", "2020-01-02T00", "1/2/2020/"]], "c string").repartition(4)
    got = df.select(*[(~parse._to_date(F.col("c"), f).eqNullSafe(F.try_to_date("c", f))).alias(f.replace("/", "_")) for f in DATE_FORMATS])
    assert got.where(" or ".join(f"`{c}`" for c in got.columns)).count() == 0


def test_parsers_raise_no_errors_inside_for_usual_texts(spark):
    """A cast or parse that fails inside Spark costs many times one that fits."""
    import time

    from pyspark.sql import functions as F

    from hrlens.functions.parse import parse_date_multi, to_int, to_number

    day = F.date_add(F.lit("2012-01-01").cast("date"), (F.col("id") % 4000).cast("int"))
    df = spark.range(0, 400_000, 1, 4).select(F.date_format(day, "dd-MM-yyyy").alias("d"), F.date_format(day, "yyyy-MM-dd").alias("iso"), F.concat("id", F.lit(".0")).alias("f")).cache()
    df.count()

    def seconds(c):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            df.select(c).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(to_int(F.col("f"))) < 4 * seconds(to_number(F.col("f")))
    assert seconds(parse_date_multi(F.col("d"))) < 4 * seconds(parse_date_multi(F.col("iso")))
    df.unpersist()
