"""hrlens: workforce analytics as distributed Spark DataFrame plans.

Layout
------
sources/    readers and writers (raw CSV, typed tables, derived views)
functions/  Column -> Column expressions (cleaners, exact rounding, tenure)
operators/  reusable DataFrame -> DataFrame operators (rates, gaps, windows,
            hierarchy joins, cleaning, profiling, validation)
plans/      the named analyses and the cleaning run built from the operators
streaming/  incremental cleaning of raw files with Structured Streaming
"""

from hrlens.schemas import SNAPSHOT  # noqa: F401

__all__ = ["SNAPSHOT"]
