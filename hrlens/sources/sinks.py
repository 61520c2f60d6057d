"""Writers: CSV that round-trips exactly, Parquet, and a write report."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',  # double embedded quotes instead of backslash-escaping
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",  # keep " Ade, S.Pd " as written
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""',
    "nullValue": "",
    "dateFormat": "yyyy-MM-dd",
}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A folder of CSV part files, one per partition (no coalesce to one
    file: every task writes its own part)."""
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite"
) -> str:
    """Parquet, optionally partitioned by low-cardinality columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_table(
    df: DataFrame, out_dir: str, table: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> str:
    """One table under ``out_dir``; Parquet may be partitioned by low-cardinality
    columns (e.g. reviews by ``review_period``) so period filters prune files."""
    path = os.path.join(out_dir, table)
    if fmt == "csv":
        return write_csv(df, path)
    return write_parquet(df, path, partition_by)


def write_report(spark: SparkSession, out_dir: str, tables: list[str], fmt: str = "parquet") -> DataFrame:
    """(table, rows, cols) for written tables, read back from storage: the
    row counts run as distributed jobs over the written files."""
    from hrlens.sources.raw import read_clean

    parts = []
    for name in tables:
        df = read_clean(spark, out_dir, name, fmt)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("cols")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def written_files(spark: SparkSession, out_dir: str, table: str, fmt: str = "parquet") -> list[str]:
    """Data files backing a written table (listing metadata, not rows)."""
    from hrlens.sources.raw import read_clean

    return sorted(read_clean(spark, out_dir, table, fmt).inputFiles())
