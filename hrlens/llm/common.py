"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.session import ensure_checkpoint_dir

# Word separators of every contract here: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    in storage that outlives any executor. The shuffle files behind it are
    removed once it stands."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows a Python worker gets at a time: long texts then stay within a
    worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def byte_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes that a Python worker gets at a time: one value for all
    operators, so that it does not matter which of them sets it last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def identity(docs: DataFrame) -> list[Column]:
    """Two hashes of all that a row holds; rows with equal ones are equal."""
    cols = [F.to_json(F.struct(_named(c))) if "map<" in t else _named(c) for c, t in docs.dtypes]
    return [F.xxhash64(F.lit(seed), *cols).alias(seed) for seed in ("h1", "h2")]


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def pack(names: list[str]) -> Column:
    """The columns ``names`` as one struct ``body``, out of the way of an
    operator's own names."""
    return F.struct(*[_named(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("body")


def unpack(names: list[str]) -> list[Column]:
    """The columns that ``pack`` put away."""
    return [F.col(f"body.c{i}").alias(c) for i, c in enumerate(names)]
