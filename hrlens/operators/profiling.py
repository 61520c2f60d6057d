"""Profiling: inspections that are small result DataFrames, not prints.

Each function computes its answer with one distributed aggregation; nothing
is collected here, so profiles compose and run where the data lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.operators.joins import dealt
from hrlens.operators.quality import union_all


def shape(df: DataFrame, table: str) -> DataFrame:
    """(table_name, rows, cols)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table_name"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
    )


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([shape(df, name) for name, df in tables.items()])


def head(df: DataFrame, n: int, order: list[str], cols: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (a top-n, so it is deterministic)."""
    out = df.select(*cols) if cols else df
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    """(table_name, rows, duplicate_rows): rows equal to an earlier row,
    like pandas ``duplicated().sum()``; NULLs compare equal."""
    # Nearly every row is a group of its own: dealt out before it is grouped, by
    # a hash, since Spark drops constant columns from a grouping.
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    groups = dealt(hashed, df, "_h").groupBy("_h", *df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows")
    ).select(
        F.lit(table).alias("table_name"),
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce("duplicate_rows", F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL values of ``col`` (order at the edge if shown)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, NULL included as its own group."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def parse_failures(raw: Column, parsed: Column, ambiguous: Column | None = None) -> list[Column]:
    """Aggregates: present inputs that parsed to NULL, and (optionally) how
    many inputs were ambiguous."""
    out = [F.count_if(raw.isNotNull() & parsed.isNull()).alias("unparsed")]
    if ambiguous is not None:
        out.append(F.count_if(ambiguous).alias("ambiguous"))
    return out


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing) for columns with at least one NULL, from one
    pass over the data."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, missing)")
    return long.where(F.col("missing") > 0)


def min_max(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def dtypes(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(column_name, data_type) from the schema (metadata, no data scan)."""
    return spark.createDataFrame(df.dtypes, "column_name string, data_type string")


def _parse_checks() -> dict[str, list[tuple[str, str, object]]]:
    """Per raw table: (metric, column, failing predicate on the column's raw
    text and what the cleaner made of it)."""
    from hrlens.functions.parse import is_ambiguous_date

    def unparsed(raw, clean):
        return raw.isNotNull() & clean.isNull()

    def ambiguous(raw, clean):
        return is_ambiguous_date(raw)

    return {
        "employees": [
            ("unparsed:hire_date", "hire_date", unparsed),
            ("ambiguous:hire_date", "hire_date", ambiguous),
            ("unparsed:termination_date", "termination_date", unparsed),
            ("unparsed:monthly_salary_idr", "monthly_salary_idr", unparsed),
        ],
        "salaries": [
            ("unparsed:effective_date", "effective_date", unparsed),
            ("ambiguous:effective_date", "effective_date", ambiguous),
        ],
        "goals": [("unparsed:achievement_pct", "achievement_pct", unparsed)],
    }


def cleaning_profile(raw: dict[str, DataFrame]) -> DataFrame:
    """The step-by-step checks of an interactive cleaning session as one
    table of (table_name, metric, value): raw rows and duplicate rows, rows
    after cleaning, NULLs left per column, and parse failures / ambiguous
    dates (counted after de-duplication, as in the session). Two passes per
    table: a duplicate count over the raw rows, and one aggregation over the
    cleaned rows that carries copies of the raw columns it needs."""
    from hrlens.operators.cleaning import CLEANERS

    checks = _parse_checks()
    parts = []
    for table, df in raw.items():
        parts.append(duplicate_rows(df, table).selectExpr(
            "table_name", "stack(2, 'raw_rows', rows, 'raw_duplicate_rows', duplicate_rows) as (metric, value)"
        ))
        mine = checks.get(table, [])
        needed = sorted({c for _, c, _ in mine})
        staged = df.select("*", *[F.col(c).alias(f"_raw_{c}") for c in needed])
        clean = CLEANERS[table](staged, keep=tuple(f"_raw_{c}" for c in needed))
        cols = [c for c in clean.columns if not c.startswith("_raw_")]
        aggs = [F.count(F.lit(1)).alias("clean_rows")]
        aggs += [F.count_if(F.col(c).isNull()).alias(f"null_after_cleaning:{c}") for c in cols]
        aggs += [F.count_if(pred(F.col(f"_raw_{c}"), F.col(c))).alias(name) for name, c, pred in mine]
        wide = clean.agg(*aggs)
        stack = ", ".join(f"'{a}', `{a}`" for a in wide.columns)
        long = wide.selectExpr(f"'{table}' as table_name", f"stack({len(wide.columns)}, {stack}) as (metric, value)")
        parts.append(long.where(~F.col("metric").startswith("null_after_cleaning:") | (F.col("value") > 0)))
    return union_all([p.select("table_name", "metric", F.col("value").cast("bigint").alias("value")) for p in parts])
