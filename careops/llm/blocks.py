"""Buckets whose members must be compared with each other, cut into bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, keys: list[str], spread: list[str], block: int,
                having: str = "count(*) > 1") -> DataFrame:
    """Lay out each bucket (equal ``keys``) as pairs of blocks of about ``block`` rows.

    A bucket of one row goes, and one for which the aggregate condition ``having`` fails.  One of at most ``block`` rows is one group; a
    larger one is dealt to ceil(n / block) blocks by a hash of ``spread``, and
    every pair of blocks forms a group, so no group holds much more than two
    blocks however hot the bucket is and every pair of rows meets in a group.
    Adds ``lo``, ``hi`` (the group's blocks) and ``blk`` (the row's own).
    The counts are combined before their shuffle and joined back, a join
    whose hot keys adaptive execution can split.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.expr(having).alias("__ok")).filter(
        "__n > 1 and __ok").drop("__ok")
    dealt = rows.join(counts, keys).withColumn("__b", F.ceil(F.col("__n") / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64(*spread), F.col("__b")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return dealt.select(
        *rows.columns, "blk", F.least("blk", "__o").alias("lo"), F.greatest("blk", "__o").alias("hi"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], handle: Callable[[pa.Table], pa.Table | None],
            rows: int = 20000) -> Iterator[pa.RecordBatch]:
    """Feed ``handle`` with tables of whole groups from sorted batches, about ``rows`` rows at a time."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    count = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        got = handle(table) if table.num_rows else None
        if got is not None:
            yield from got.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(table.num_rows, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from out(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        count = table.num_rows - cut
    if held:
        yield from out(pa.Table.from_batches(held))
