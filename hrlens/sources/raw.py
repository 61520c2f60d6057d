"""Readers for raw (all-string) and clean (typed) CSV/Parquet tables."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrlens.schemas import NULL_TOKENS, TABLES, clean_schema, raw_schema
from hrlens.session import scratch_path
from hrlens.sources.derive import HRTables
from hrlens.sources.versions import current

CSV_READ_OPTIONS = {
    "header": "true",
    "escape": '"',  # doubled quotes inside quoted fields
    "mode": "FAILFAST",  # a row with too few or too many fields is an error
    "enforceSchema": "false",  # so is a file whose header is not the schema's
}


def _read_csv(spark: SparkSession, path: str | list[str], types: T.StructType, options: dict) -> DataFrame:
    """CSV columns bound by the names in the header, whatever their order; a
    missing column is an error. Finding the names reads one line."""
    options = CSV_READ_OPTIONS | options
    header = spark.read.options(**options).csv(path).columns
    known = {f.name: f.dataType for f in types}
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType()), True) for c in header])
    return spark.read.schema(schema).options(**options).csv(path).select(*types.fieldNames())


def quoted_breaks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, breaks``: whether a file's lines may be no records.

    A quoted field with a line break leaves its first line with an odd number
    of quotes. A file begins outside quotes, so where every line holds an even
    number, every line also begins outside: each is a record, and the file can
    be read in splits. The count per line needs nothing from other lines, so
    this scan is itself split; a stray quote counts as a break, to be safe."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(F.bool_or(quotes % 2 == 1).alias("breaks"))


def read_csv(spark: SparkSession, path: str, types: T.StructType, options: dict | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV table whose files are read in splits wherever that is right.

    With ``multi_line=None`` the files are scanned for quoted line breaks
    (``quoted_breaks``). Those without any are read in splits. The others, of
    which a file is a task, are read once and converted to Parquet in the
    shared checkpoint folder, so all later work on them is split too. True
    reads every file as one task without a scan, False all in splits."""
    options = options or {}
    if multi_line is not None:
        return _read_csv(spark, path, types, options | {"multiLine": str(multi_line).lower()})
    broken = {unquote(r.file) for r in quoted_breaks(spark, path).where("breaks").select("file").collect()}
    if not broken:
        return _read_csv(spark, path, types, options | {"multiLine": "false"})
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    whole = [f for f in files if _plain(f) in {_plain(b) for b in broken}]
    split = [f for f in files if f not in whole]
    converted = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    _read_csv(spark, whole, types, options | {"multiLine": "true"}).write.parquet(converted)
    out = spark.read.schema(types).parquet(converted)
    return out.unionByName(_read_csv(spark, split, types, options | {"multiLine": "false"})) if split else out


def _plain(file: str) -> str:
    """A file's name without the slashes that writers of URIs disagree on."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


def null_tokens_to_null(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Map the spellings a CSV export uses for "missing" to NULL, in every
    column (one projection; no row leaves the executors)."""
    return df.select(
        *[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) for c in df.columns]
    )


def _path(data_dir: str, table: str, ext: str) -> str:
    """``<table>.<ext>`` (one file per table) or ``<table>/`` (a folder of part
    files), as one Hadoop glob, so no existence check runs on the driver and
    the same call works on any file system."""
    return os.path.join(data_dir, f"{table}{{.{ext},}}")


def read_raw(spark: SparkSession, data_dir: str, table: str, multi_line: bool | None = None) -> DataFrame:
    """An untyped export: header row, comma separated, every column STRING.
    Files are read in splits unless they hold quoted line breaks (``read_csv``)."""
    return null_tokens_to_null(read_csv(spark, _path(data_dir, table, "csv"), raw_schema(table), multi_line=multi_line))


def read_clean(spark: SparkSession, data_dir: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A typed clean table written by ``sinks.write_table``, of the current
    version where ``data_dir`` is published in versions."""
    data_dir = current(spark, data_dir)
    if fmt == "csv":
        return read_csv(spark, _path(data_dir, table, "csv"), clean_schema(table), {"dateFormat": "yyyy-MM-dd"})
    schema = clean_schema(table)
    # Partition columns come back last; restore the table's column order.
    return spark.read.schema(schema).parquet(_path(data_dir, table, "parquet")).select(*schema.fieldNames())


def read_clean_tables(spark: SparkSession, data_dir: str, fmt: str = "parquet") -> HRTables:
    """All five clean tables, ready for the analyses."""
    t = {name: read_clean(spark, data_dir, name, fmt) for name in TABLES}
    return HRTables(**t)


def register_tables(tables: HRTables, prefix: str = "") -> list[str]:
    """Expose the five tables to ``spark.sql`` as temp views named
    ``<prefix>departments``, ``<prefix>employees``, ... so analyses can also
    be written as SQL against the clean schema."""
    names = []
    for name, df in tables.as_dict().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
