"""Property tests: the Spark cleaners equal Python's own string methods (what
the pandas cleaner calls) on random text, checked in one Spark job per batch."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hrlens.functions.parse import parse_currency, to_int
from hrlens.functions.text import clean_text, strip, title_case

# Letters whose upper/lower case maps one-to-one in both Python and Java,
# digits, punctuation and a spread of whitespace (tab, NBSP, ideographic).
ALPHABET = st.sampled_from(
    list("abcXYZ019'.,-&/ ") + ["é", "Ñ", "ü", "Ö", "ß", "中", "ª", "\t", "\n", " ", " ", "　", "\x1c"]
)
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=40)


def _run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_strip_and_collapse_match_python(spark, values):
    assert _run(spark, strip, values) == [v.strip() for v in values]
    assert _run(spark, clean_text, values) == [re.sub(r"\s+", " ", v.strip()) for v in values]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_title_case_matches_python(spark, values):
    assert _run(spark, title_case, values) == [v.title() for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**15), min_size=1, max_size=30))
def test_currency_and_int_round_trip(spark, amounts):
    rp = ["Rp" + f"{a:,}".replace(",", ".") for a in amounts]
    assert _run(spark, parse_currency, rp) == amounts
    assert _run(spark, to_int, [f"{a}.0" if a < 2**53 else str(a) for a in amounts]) == amounts


@st.composite
def dated_texts(draw):
    """A text and the date that it must give."""
    import datetime as dt

    d = dt.date(1990, 1, 1) + dt.timedelta(days=draw(st.integers(0, 15000)))
    width = draw(st.sampled_from([1, 2]))
    dd, mm = f"{d.day:0{width}d}", f"{d.month:0{width}d}"
    swapped = dt.date(d.year, d.day, d.month) if d.day <= 12 else d  # read day first where it can be
    text, expected = draw(
        st.sampled_from(
            [
                (f"{d.year}-{mm}-{dd}", d),
                (f"{dd}/{mm}/{d.year}", d),
                (f"{mm}/{dd}/{d.year}", swapped),
                (f"{dd}-{mm}-{d.year}", d),
                (f"{dd}/{mm}/{d.year % 100:02d}", None),
                (f"{32 + d.day}/{mm}/{d.year}", None),
                (f"{mm}-{13 + d.day}-{d.year}", None),
                ("", None),
            ]
        )
    )
    return draw(st.sampled_from(["", " ", "\t"])) + text + draw(st.sampled_from(["", " "])), expected


@settings(max_examples=10, deadline=None)
@given(st.lists(dated_texts(), min_size=1, max_size=60))
def test_parse_date_gives_the_expected_date(spark, cases):
    from hrlens.functions.parse import parse_date_multi

    texts, expected = zip(*cases)
    assert _run(spark, parse_date_multi, list(texts)) == list(expected)


NUMBER_TEXTS = st.lists(
    st.one_of(
        st.decimals(min_value=-10**6, max_value=10**6, places=2, allow_nan=False).map(str),
        st.integers(-10**9, 10**9).map(str),
        st.integers(0, 10**6).map(lambda i: f" {i}.0 "),
        st.sampled_from(["", "abc", "1,000", "nan", "NaN", "12.5.1", "--3", "12d", "85f", "0x1p3", "7D", "1e3", ".5", "5.", "+4", "."]),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=10, deadline=None)
@given(NUMBER_TEXTS)
def test_numbers_match_pandas_to_numeric(spark, texts):
    import math

    import pandas as pd

    from hrlens.functions.parse import to_int, to_number

    ref = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce")
    expected = [None if (v is None or (isinstance(v, float) and math.isnan(v))) else float(v) for v in ref]
    assert _run(spark, to_number, texts) == expected
    # Integer columns: pandas then casts to Int64; integral values survive,
    # fractional ones make pandas raise where the Spark cleaner gives NULL.
    ints = [None if e is None or e != int(e) else int(e) for e in expected]
    assert _run(spark, to_int, texts) == ints
