"""Which slash-date order a column uses, by the values that allow only one.

``25/04/2021`` can only be day-first and ``04/25/2021`` only month-first;
``05/04/2021`` says nothing. Where a column has more month-first evidence, its
ambiguous values are read month-first; otherwise the first match (day-first)
stays. Counts come from one scan over all columns, combined map-side.

Cases: nulls, blanks and text of no known format count as ``unread``; a column
without evidence, or an empty table, keeps the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.functions.parse import blank_to_null, parse_date_multi
from hrlens.schemas import DATE_FORMATS

DAY_FIRST, MONTH_FIRST = "d/M/yyyy", "M/d/yyyy"


def _kinds(c: Column) -> dict[str, Column]:
    t = blank_to_null(c)
    day, month = F.try_to_date(t, DAY_FIRST), F.try_to_date(t, MONTH_FIRST)
    return {
        "day_first_only": day.isNotNull() & month.isNull(),
        "month_first_only": month.isNotNull() & day.isNull(),
        "either": day.isNotNull() & month.isNotNull(),
        "other_format": day.isNull() & month.isNull() & parse_date_multi(c).isNotNull(),
        "unread": parse_date_multi(c).isNull(),
    }


def date_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: ``column_name``, the counts, ``chosen``."""
    structs = [F.struct(F.lit(c).alias("column_name"), *[F.count_if(x).alias(k) for k, x in _kinds(F.col(c)).items()]) for c in columns]
    rows = df.agg(F.array(*structs).alias("_e")).select(F.inline("_e"))
    chosen = F.when(F.col("month_first_only") > F.col("day_first_only"), "month_first").otherwise("day_first")
    return rows.withColumn("chosen", chosen)


def ordered_formats(month_first: bool, formats: list[str] = DATE_FORMATS) -> list[str]:
    """``formats`` for ``parse_date_multi``, the chosen slash order first."""
    if not month_first:
        return formats
    swap = {DAY_FIRST: MONTH_FIRST, MONTH_FIRST: DAY_FIRST}
    return [swap.get(f, f) for f in formats]


def parse_dates_by_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` as dates, each read in its own order. The
    choice is joined from the counts (a row a column), not collected."""
    evidence = date_evidence(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.col("chosen") == "month_first"))).alias("_month"))
    by = df.withColumn("_month", evidence.scalar())
    dates = {c: F.when(F.col("_month")[c], parse_date_multi(F.col(c), ordered_formats(True))).otherwise(parse_date_multi(F.col(c))) for c in columns}
    return by.withColumns(dates).drop("_month")
