"""Rows dealt by key into partitions of a bounded number of rows.

Adaptive execution joins shuffle partitions up to a number of compressed
bytes.  Narrow rows compress well, so one such partition can hold millions of
them, and sorts and hash maps over them take memory in proportion.  Where a
step builds several of those, its rows are dealt by count instead: more rows
mean more partitions, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows of a partition: a few sorts of them stay at some hundred MB.
ROWS_PER_TASK = 500_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows: as many as the session has cores, or more where they would be too large."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into ``tasks`` partitions; with None the planner deals the rows itself."""
    return df if tasks is None else df.repartition(tasks, *keys)
