"""Row numbering within groups that may be huge.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task.  ``row_number_within`` gives the same numbers with the work
spread by sort key:

1. identical rows collapse to ``(row, copies)`` with a map-side aggregate;
2. range-partition on ``(g, o, other columns)`` — unique per row — so a
   group holding a third of all rows spans many partitions;
3. inside each ``(partition, group)`` piece a running sum of copies gives
   each row its last number within the piece;
4. copies per piece, summed over the earlier pieces of the group, give each
   piece its offset.  Only a group that began in an earlier range has one,
   and a range holds at most one such group, so the offsets are bounded by
   the number of ranges and are broadcast; the rows do not move again;
5. each row expands back to its copies with consecutive numbers (large
   copy counts are split across tasks).

Steps 2 to 4 are ``running_total_within``.  The partition id is pinned with a
checkpoint before two branches read it (see ``careops.functions.nearest`` for
why).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careops.functions.materialize import checkpoint
from careops.functions.ranges import range_pieces
from careops.functions.rows import replicate_rows


def running_total_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str = "running_total",
    num_partitions: int | None = None,
) -> DataFrame:
    """``df`` plus ``out`` = sum of ``value`` over the rows of its group up to and with this one, by ``order``.

    ``order`` must tell the rows of a group apart.  NULL is a group of its own.
    """
    cols = df.columns
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = range_pieces(df, [*[F.col(g) for g in group], *order_cols], num_partitions)
    piece = ["_pid", *group]
    upto = Window.partitionBy(*piece).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = checkpoint(ranged.withColumn("_last", F.sum(value).over(upto)))
    sizes = local.groupBy(*piece).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(piece)],
        F.sum("_n").over(before).alias("_offset"),
    ).filter(F.col("_offset").isNotNull())
    # NULL is a group of its own, as in PARTITION BY: join null-safely.
    same = [local[c].eqNullSafe(offsets[f"_o{i}"]) for i, c in enumerate(piece)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    offset = F.coalesce(F.col("_offset"), F.lit(0))
    return local.join(F.broadcast(offsets), cond, "left").select(*cols, (F.col("_last") + offset).alias(out))


def row_number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    out: str = "row_number",
    num_partitions: int | None = None,
) -> DataFrame:
    """``df`` plus ``out`` = 1-based position of the row in its group by ``order``.

    ``order`` is ascending with NULLs first (Spark's default); give Column
    expressions such as ``F.col("t").desc()`` for other directions.  Rows
    tied on ``order`` are ordered by their remaining columns; identical rows
    get consecutive numbers, as any ``row_number`` would give them.
    """
    group = list(group)
    cols = df.columns
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    named = set(group) | {c for c in order if isinstance(c, str)}
    rest = [F.col(c) for c in cols if c not in named]

    # Identical rows collapse to one row and a count before any shuffle, so a
    # group of copies never travels as copies; the sort key is then unique.
    distinct_rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = running_total_within(
        distinct_rows, group, [*order_cols, *rest], "_copies", "_end", num_partitions
    ).select(*cols, "_copies", (F.col("_end") - F.col("_copies") + 1).alias("_first"))
    copies = replicate_rows(numbered, "_copies", index_col="_k")
    return copies.select(*cols, (F.col("_first") + F.col("_k")).cast("int").alias(out))
