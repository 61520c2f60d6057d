"""String -> typed parsers that return NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hrlens.functions.text import strip
from hrlens.schemas import DATE_FORMATS, GENDER_MAP


def blank_to_null(c: Column) -> Column:
    t = strip(c)
    return F.when(t != "", t)


def canonicalise(c: Column, mapping: dict[str, str]) -> Column:
    """Look up ``lower(strip(c))`` in ``mapping``; unmapped or NULL -> NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(c)))


def canonical_gender(c: Column) -> Column:
    return canonicalise(c, GENDER_MAP)


# What a text must hold for a format to fit: its separator, and a month between
# them. A parse that fails raises an error inside Spark, which takes longer
# than all the rest of a cleaner's work on the cell.
_MONTH = "0*([1-9]|1[0-2])"
DATE_SHAPES = {
    "yyyy-M-d": ("-", f"^[+-]?[0-9]{{4,}}-{_MONTH}-"),
    "d-M-yyyy": ("-", f"^[0-9]+-{_MONTH}-"),
    "d/M/yyyy": ("/", f"^[0-9]+/{_MONTH}/"),
    "M/d/yyyy": ("/", f"^{_MONTH}/"),
}


def _to_date(t: Column, fmt: str) -> Column:
    """``try_to_date`` of the texts that may fit; the others are NULL at once."""
    if fmt not in DATE_SHAPES:
        return F.try_to_date(t, fmt)
    separator, shape = DATE_SHAPES[fmt]
    return F.when(t.contains(separator) & t.rlike(shape), F.try_to_date(t, fmt))


def parse_date_multi(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """The first of ``formats`` that parses the stripped text, else NULL.

    Single ``d``/``M`` letters accept one or two digits; impossible dates
    (30/02), two-digit years and trailing text give NULL."""
    t = blank_to_null(c)
    return F.coalesce(*[_to_date(t, f) for f in formats])


def is_ambiguous_date(c: Column) -> Column:
    """True when the text parses both day-first and month-first to different
    dates (e.g. 05/04/2021); the first-match rule then picks day-first."""
    t = blank_to_null(c)
    return F.coalesce(_to_date(t, "d/M/yyyy") != _to_date(t, "M/d/yyyy"), F.lit(False))


def parse_currency(c: Column) -> Column:
    """Drop ``Rp``, dots, commas and spaces, then read an integer
    (``Rp30.100.000`` -> 30100000). A decimal point is removed too, so
    ``1234.0`` reads as 12340: read amounts as text, never via a float."""
    # Literal replace and translate (no regular expression per row); removing
    # "Rp" before the separators matches the text being cleaned in that order.
    digits = F.translate(F.replace(strip(c), F.lit("Rp"), F.lit("")), "., ", "")
    return digits.try_cast("bigint")


# What pandas.to_numeric reads; Java's own parser also takes 12d, 85f and 0x1p3.
WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def _number_text(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(NUMBER), t)


def to_number(c: Column) -> Column:
    """Numeric text -> DOUBLE; unparsable and NaN text -> NULL."""
    return _number_text(c).try_cast("double")


def parse_percent(c: Column) -> Column:
    """``85%`` / ``85.0`` / `` 7 % `` -> DOUBLE; otherwise NULL."""
    return to_number(F.replace(c, F.lit("%"), F.lit("")))


def to_int(c: Column) -> Column:
    """Integral text -> BIGINT, accepting float spellings such as ``1234.0``
    (how a nullable integer column is written after passing through floats).
    Fractional values (``12.5``) and junk -> NULL. Plain digit strings take an
    exact path, so ids beyond 2^53 survive."""
    t = strip(c)
    exact = F.when(t.rlike(WHOLE), t.try_cast("bigint"))  # on others the cast raises an error inside
    d = to_number(c)
    via_double = F.when(d == F.floor(d), d.try_cast("bigint"))
    return F.coalesce(exact, via_double)
