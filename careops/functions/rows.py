"""Row multiplicity helpers.

Some warehouse statements join a relation with a non-distinct one, so a row
comes out once per matching row.  The operators reproduce that exactly, but
by shuffling one pre-aggregated ``(key, count)`` row per key and expanding
after the join; a hot key never moves its duplicates through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Copies produced by one task for one input row before the copies are split
# into chunks and spread over tasks.
DEFAULT_CHUNK = 4096


def replicate_rows(
    df: DataFrame, count_col: str, chunk: int = DEFAULT_CHUNK, index_col: str | None = None
) -> DataFrame:
    """Emit each row ``count_col`` times (0 or NULL: dropped); drops the column.

    ``index_col``, if given, numbers the copies of a row 0, 1, …, n−1.
    """
    rest = [c for c in df.columns if c != count_col]
    n = F.col(count_col).cast("long")
    # First one row for each chunk of a count (most counts are one chunk),
    # dealt anew where adaptive execution sees large partitions, then the
    # copies of each chunk; the input is planned once.
    chunks = df.filter(n > 0).select(
        *rest, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk))).alias("_chunk")
    ).hint("rebalance")
    copies = F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_chunk") * chunk)
    out = chunks.select(
        *rest, "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_pos")
    ).select(*rest, (F.col("_chunk") * chunk + F.col("_pos")).cast("int").alias("_copy"))
    if index_col is None:
        return out.drop("_copy")
    return out.withColumnRenamed("_copy", index_col)
