"""Join helpers: dimensions, existence filters, orphan finders.

No join carries a broadcast hint: Spark broadcasts a side whose size in bytes
is below ``spark.sql.autoBroadcastJoinThreshold`` by the plan's statistics, or
by what a shuffle has measured (AQE), and shuffles it otherwise. Building a
query runs no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of stored input for each part of ``dealt``.
PART_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int | None:
    """Stored bytes of the tables that ``df`` reads (a table read twice counts
    twice), by its scans' statistics, so that no job runs; None if unknown."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size if size < 1 << 60 else None  # Spark's own default stands for an unknown size


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` into parts whose number grows with the
    input of ``source``, so that what a task holds does not.

    Left to itself, Spark merges a shuffle's parts to one per core, or up to
    64 MB of compressed bytes: for ids, of which a byte or two is left, that is
    tens of millions of rows a task."""
    size = input_bytes(source)
    return rows.repartition(*keys) if size is None else rows.repartition(max(1, -(-size // PART_BYTES)), *keys)


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    key: str | list[str] | Column,
    how: str = "inner",
) -> DataFrame:
    """Join a fact to a dimension."""
    return fact.join(dim, key, how)


def exists_in(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keep fact rows whose ``key`` exists in ``dim`` (an inner join used only
    as a filter, written as a semi join so no dimension column is carried)."""
    return fact.join(dim.select(key), key, "left_semi")


def orphans(
    child: DataFrame, child_col: str, parent: DataFrame, parent_col: str
) -> DataFrame:
    """Distinct non-NULL ``child_col`` values with no matching ``parent_col``.

    NULLs are dropped first (a NULL foreign key is not a violation; an anti
    join would otherwise return it)."""
    keys = child.select(F.col(child_col).alias("_fk")).where(F.col("_fk").isNotNull())
    parents = parent.select(F.col(parent_col).alias("_pk"))
    return (
        keys.distinct()
        .join(parents, F.col("_fk") == F.col("_pk"), "left_anti")
        .select(F.col("_fk").alias(child_col))
    )
