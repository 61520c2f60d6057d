"""Reporting lines as a whole: depth, top and cycles by pointer doubling.

Every employee starts with a pointer to the manager. In each round the pointer
becomes that of the employee it points to, so it reaches twice as far; rounds
go with the logarithm of the longest line. A line that ends gives depth and
top. When a round no longer lowers the number of employees that are pointed
to, these are the ones on cycles, and the lines still open hang on one. Each
round is written to the shared folder, so lineage stays short and a
lost executor repeats one round at most.

Only open lines are joined in a round; a manager of a third of all employees
is a hot key on one side of an inner join, which AQE splits.

Cases: a null manager, or one that is no employee, ends the line; an id with
several rows has the smallest manager of them; null ids are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.session import scratch_path


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _targets(state: DataFrame) -> int:
    """How many employees are pointed to. Pointers twice as far reach a subset
    of these; where it is all of them, each is on a cycle."""
    return state.where("up is not null").select("up").distinct().count()


def reporting_lines(emp: DataFrame, key: str = "employee_id", manager: str = "manager_id") -> DataFrame:
    """``employee_id``, ``depth`` (managers above) and ``root_id`` (the top of
    the line), both null where the line never ends, ``in_cycle`` (on a cycle)."""
    folder = scratch_path(emp.sparkSession, f"lines-{uuid.uuid4().hex}")
    people = emp.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(manager).alias("m"))
    known = people.select(F.col("id").alias("up"))
    state = people.join(known, F.col("m") == F.col("up"), "left").select(
        "id", "up", F.coalesce("up", "id").alias("far"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth")
    )
    state = _written(state, folder, "0")
    targets, before, k = _targets(state), None, 0
    while targets and targets != before:
        to = state.select(F.col("id").alias("up"), F.col("up").alias("on"), F.col("far").alias("top"), F.col("depth").alias("more"))
        open_lines = state.where("up is not null").join(to, "up")
        moved = open_lines.select("id", F.col("on").alias("up"), F.col("top").alias("far"), (F.col("depth") + F.col("more")).alias("depth"))
        k, before = k + 1, targets
        state = _written(state.where("up is null").unionByName(moved), folder, str(k))
        targets = _targets(state)
    ends = F.col("up").isNull()
    cyclic = state.where("up is not null").select(F.col("up").alias("id")).distinct().withColumn("_c", F.lit(True))
    return state.join(cyclic, "id", "left").select(
        F.col("id").alias(key),
        F.when(ends, F.col("depth")).alias("depth"),
        F.when(ends, F.col("far")).alias("root_id"),
        F.coalesce("_c", F.lit(False)).alias("in_cycle"),
    )
