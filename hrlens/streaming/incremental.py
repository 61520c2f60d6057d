"""Incremental cleaning of raw exports with Structured Streaming.

New raw CSV files landing in ``<raw_dir>/<table>/`` are cleaned as they
arrive into a Parquet sink. The row-local cleaners (departments, salaries,
goals) run unchanged on the stream. The tables cleaned with full-row
de-duplication (employees, reviews) are de-duplicated by the stream itself:
``dropDuplicates`` keyed on a SHA-256 digest of the raw row keeps one
32-byte state entry per distinct row, so a row repeated in a later file is
dropped without rescanning what was already published. Progress, sink
commits and the de-duplication state live in the checkpoint location, so a
restarted query (or one that lost executors) resumes exactly where it
stopped. For large histories use the RocksDB state store
(``STATE_STORE_CONF``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hrlens.operators.cleaning import CLEANERS
from hrlens.schemas import TABLE_COLUMNS, raw_schema
from hrlens.sources.raw import CSV_READ_OPTIONS, null_tokens_to_null

DEDUPED = {"employees", "performance_reviews"}
DIGEST = "raw_digest"
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def raw_stream(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """The raw CSV files of one table as a stream of all-string rows (NULL
    tokens mapped)."""
    src = (
        spark.readStream.schema(raw_schema(table))
        .options(**CSV_READ_OPTIONS)
        .csv(os.path.join(raw_dir, table))
    )
    return null_tokens_to_null(src)


def raw_digest(cols: list[str]) -> F.Column:
    """SHA-256 of the raw row, each value behind its length; NULL is distinct
    from every string."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("n")) for c in cols]
    return F.sha2(F.concat(*parts), 256)


def cleaned_stream(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """The table's cleaner applied to the stream; de-duplicating tables keep
    one row per raw-row digest."""
    src = raw_stream(spark, raw_dir, table)
    if table not in DEDUPED:
        return CLEANERS[table](src)
    distinct = src.withColumn(DIGEST, raw_digest(TABLE_COLUMNS[table])).dropDuplicates([DIGEST])
    return CLEANERS[table](distinct, keep=(DIGEST,), dedupe=False)


def clean_stream(
    spark: SparkSession,
    raw_dir: str,
    table: str,
    out_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start cleaning ``raw_dir/<table>/*.csv`` into Parquet at
    ``out_dir/<table>``. With ``available_now`` the query processes the files
    present and stops; otherwise it polls every minute."""
    writer = (
        cleaned_stream(spark, raw_dir, table)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", os.path.join(out_dir, table))
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime="1 minute")
    return writer.start()
