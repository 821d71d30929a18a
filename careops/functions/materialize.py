"""Cutting lineage at reuse points.

A relation read by several branches of one plan, or at the end of a long
lineage, is written once to the shared folder named by
``spark.checkpoint.dir`` (reliable storage: a lost executor does not force
recomputing the upstream plan).  Machine-local checkpoints are never used.

``checkpoint`` keeps rows in Spark's own format; ``written`` keeps them as
Parquet, so that the planner knows their size in bytes (a join with a small
one becomes a broadcast under the session's byte threshold, and stays a
shuffled join beyond it) and reads only the columns it needs.

``recorded`` collects the relations cut this way while a query is built, so
that a plan check can see them beside the final plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from careops.session import ensure_checkpoint_dir

_recorders: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Inside the block, every relation that is cut is also put into the list."""
    frames: list[DataFrame] = []
    _recorders.append(frames)
    try:
        yield frames
    finally:
        _recorders.remove(frames)


def _record(df: DataFrame) -> None:
    for frames in _recorders:
        frames.append(df)


def checkpoint(df: DataFrame) -> DataFrame:
    """Eagerly write ``df`` to the session's checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    _record(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    The files stay there: the folder is the cluster's scratch space.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/relation-{uuid.uuid4().hex}"
    _record(df)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
