"""Nearest value within a key group, without pairing rows.

``nearest_points`` answers, for every query row ``(key, s)``, which point
``(key, v)`` has the largest ``v <= s`` and which the smallest ``v > s``.
A join on ``key`` with a per-query top-1 would emit every (query, point)
pair inside a key, quadratic for a busy key.  Instead:

1. Points and queries are unioned and range-partitioned on
   ``(key, value, kind, query id)``.  The sort key is unique per row, so a
   key holding a third of all rows is cut into many ranges and tasks.
2. Inside each range partition two running windows, keyed by
   ``(partition id, key)``, carry the last point seen forwards and the next
   point backwards.  Groups are bounded by one partition.
3. A partition may not contain the neighbour of its first or last query.
   A per-``(partition id, key)`` summary (one row per pair, so at most
   #keys + #partitions rows) holds each partition's first and last point; a
   running window over partitions within a key gives every partition the
   nearest point in earlier and later partitions.
4. Query rows take the local neighbour, else the carried one.  Only a key
   that crosses a range boundary carries anything: at most two keys of a
   range do, so these rows are bounded by twice the number of ranges and
   are broadcast; query rows are not shuffled again.

Cost: one range shuffle and one hash shuffle of the narrow union, one
checkpoint write of it, plus small summary shuffles.  No Python, no pairs,
no per-key task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careops.functions.materialize import checkpoint
from careops.functions.ranges import range_pieces

_POINT, _QUERY = 0, 1


def nearest_points(
    points: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    *,
    point_value: str,
    point_payload: str,
    query_id: str,
    query_value: str,
    carry: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Return ``query_id, keys..., query_value, carry..., prev, next`` per query.

    ``prev``/``next`` are structs ``(value, payload)`` (NULL when the key has
    no such point).  ``points`` must be unique on ``(keys, point_value)``;
    points with a NULL key or value are ignored.  Every query row is
    returned once; one with a NULL key or value gets NULL neighbours.
    ``carry`` names extra query columns passed through unchanged.
    """
    keys, carry = list(keys), list(carry)
    qtypes = dict(queries.dtypes)
    pay_type = dict(points.dtypes)[point_payload]
    not_null = lambda cols: F.expr(" and ".join(f"`{c}` is not null" for c in cols))
    nulls = lambda cols: [F.lit(None).cast(qtypes[c]).alias(c) for c in cols]

    p = points.filter(not_null(keys + [point_value])).select(
        *keys,
        F.col(point_value).alias("_x"),
        F.lit(_POINT).alias("_kind"),
        F.lit(None).cast(qtypes[query_id]).alias("_qid"),
        F.col(point_payload).alias("_pay"),
        *nulls(carry),
    )
    askable = not_null(keys + [query_value])
    q = queries.filter(askable).select(
        *keys,
        F.col(query_value).alias("_x"),
        F.lit(_QUERY).alias("_kind"),
        F.col(query_id).alias("_qid"),
        F.lit(None).cast(pay_type).alias("_pay"),
        *carry,
    )
    # The sort key is unique per row (points are unique per key and value,
    # queries carry their id), so a hot key is cut into many ranges.
    ranged = range_pieces(p.unionByName(q), [*keys, "_x", "_kind", "_qid"], num_partitions)

    point = F.when(F.col("_kind") == _POINT, F.struct(F.col("_x").alias("value"), F.col("_pay").alias("payload")))
    part = ["_pid", *keys]
    upto = Window.partitionBy(*part).orderBy("_x", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    after = Window.partitionBy(*part).orderBy(F.desc("_x"), F.desc("_kind")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # The partition id means "range i" only for the one range exchange that
    # assigned it.  Two branches read it (the boundary summary and the query
    # rows); if each ran its own exchange, the sampled range bounds and the
    # filters the optimizer pushes into each branch could differ.  Write it
    # once (reliable checkpoint) and let both branches read the same rows.
    local = checkpoint(ranged.select(
        *part,
        "_kind",
        "_qid",
        "_x",
        *carry,
        F.last(point, ignorenulls=True).over(upto).alias("_lprev"),
        F.last(point, ignorenulls=True).over(after).alias("_lnext"),
        point.alias("_pt"),
    ))

    # Per (partition, key): its first and last point (NULL if none).
    bounds = local.groupBy(*part).agg(
        F.min("_pt").alias("_first"), F.max("_pt").alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    carried = bounds.select(
        *part,
        F.last("_last", ignorenulls=True).over(earlier).alias("_cprev"),
        F.last("_first", ignorenulls=True).over(later).alias("_cnext"),
    ).filter(F.col("_cprev").isNotNull() | F.col("_cnext").isNotNull())

    neighbour = points.select(F.struct(F.col(point_value).alias("value"), F.col(point_payload).alias("payload"))).schema[0].dataType
    answered = (
        local.filter(F.col("_kind") == _QUERY)
        .join(F.broadcast(carried), part, "left")  # at most two rows per range
        .select(
            F.col("_qid").alias(query_id),
            *keys,
            F.col("_x").alias(query_value),
            *carry,
            F.coalesce("_lprev", "_cprev").cast(neighbour).alias("prev"),
            F.coalesce("_lnext", "_cnext").cast(neighbour).alias("next"),
        )
    )
    unaskable = queries.filter(~askable).select(
        query_id, *keys, query_value, *carry,
        F.lit(None).cast(neighbour).alias("prev"), F.lit(None).cast(neighbour).alias("next"),
    )
    return answered.unionByName(unaskable)
