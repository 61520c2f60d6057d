"""The cleaning run: read raw exports -> clean -> validate -> write.

Nothing reaches the output folder unless validation passes. The cleaned
tables are first written to a staging folder under the shared checkpoint
location (``spark.checkpoint.dir``); validation reads the staged Parquet, so
each raw file is parsed once, lineage is cut (a lost executor recomputes from
the staged files, not from the CSVs), and the publish step is a cheap
columnar copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hrlens.operators.cleaning import CLEANERS, clean_departments
from hrlens.operators.quality import assert_valid, validate_all, validate_reference
from hrlens.schemas import TABLES
from hrlens.session import scratch_path
from hrlens.sources.raw import read_clean_tables, read_raw
from hrlens.sources.sinks import write_parquet, write_report, write_table
from hrlens.sources.versions import publish


def clean_tables(spark: SparkSession, raw_dir: str, casing: str | None = None) -> dict[str, DataFrame]:
    """The five raw tables read and cleaned (lazy; nothing runs until
    written)."""
    out = {}
    for name in TABLES:
        raw = read_raw(spark, raw_dir, name)
        out[name] = clean_departments(raw, casing) if name == "departments" else CLEANERS[name](raw)
    return out


def run_cleaning(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    fmt: str = "csv",
    casing: str | None = None,
    extended_checks: bool = False,
    staging_dir: str | None = None,
    partition_by: dict[str, list[str]] | None = None,
    versioned: bool = False,
) -> DataFrame:
    """Clean the five raw tables and publish them to ``out_dir``.

    Raises ``ValidationError`` (before writing anything to ``out_dir``) when
    a check fails. Returns the write report (table, rows, cols) read back
    from the published files. ``partition_by`` maps a table to Parquet
    partition columns, e.g. ``{"performance_reviews": ["review_period"]}``.
    ``versioned`` publishes all five tables at once (``sources.versions``): a
    run killed while it writes leaves the tables of the run before readable."""
    staging = staging_dir or scratch_path(spark, f"cleaning-{uuid.uuid4().hex}")
    for name, df in clean_tables(spark, raw_dir, casing).items():
        write_parquet(df, f"{staging}/{name}")
    staged = read_clean_tables(spark, staging)
    violations = (
        validate_all(staged)
        if extended_checks
        else validate_reference(staged.employees, staged.departments)
    )
    assert_valid(violations)
    if versioned:
        publish(spark, staged.as_dict(), out_dir, fmt, partition_by)
    else:
        for name, df in staged.as_dict().items():
            write_table(df, out_dir, name, fmt, (partition_by or {}).get(name))
    return write_report(spark, out_dir, TABLES, fmt)
