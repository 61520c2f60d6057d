"""Parquet table access for a data folder (one ``<name>.parquet`` per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Table handles per session: a DataFrame is only a plan over a file listing,
# so reusing it skips repeated listing and footer reads when many queries
# run over the same snapshot. ``forget_tables`` drops them (e.g. after new
# files land).
_HANDLES: dict[tuple[int, str], DataFrame] = {}


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    path = os.path.join(data_dir, f"{name}.parquet")
    key = (id(spark), path)
    df = _HANDLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df


def forget_tables() -> None:
    _HANDLES.clear()
