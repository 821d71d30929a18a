"""Range pieces: the shared first step of the skew-proof window helpers.

``range_pieces`` range-partitions rows on a sort key and tags each row with
its range number ``_pid``.  Rows of one group (a prefix of the sort key)
that would not fit one task land in consecutive ranges, so per-piece work
is bounded by a partition, never by a group.  The range number is only
meaningful for this one exchange: callers pin it with a checkpoint before
more than one branch reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_pieces(df: DataFrame, sort_key: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``sort_key`` plus ``_pid``, its range number.

    Without ``num_partitions`` adaptive execution sizes the exchange from the
    data; coalesced ranges stay contiguous and ordered.
    """
    key = [F.col(c) if isinstance(c, str) else c for c in sort_key]
    ranged = df.repartitionByRange(num_partitions, *key) if num_partitions else df.repartitionByRange(*key)
    return ranged.withColumn("_pid", F.spark_partition_id())
