"""Deduplication state that ends with its window.

``once_in`` keeps the keys that it has seen in one long event-time window
that covers the analysis' own.  When the watermark passes that window's end,
nothing that belongs to it can come any more, and Spark drops its keys: the
state is empty after the end and does not grow again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT, _WINDOW = "_event_time", "_window"


def marked(df: DataFrame, ts_col: str, lateness: str) -> DataFrame:
    """``df`` with its event time and watermark; to be called before rows outside the window are dropped.

    All rows move the watermark, also those after the window: they are what
    tells that it is over.
    """
    return df.withColumn(EVENT, F.col(ts_col).cast("timestamp")).withWatermark(EVENT, lateness)


def once_in(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Each combination of ``keys`` once, for ``marked`` rows between ``start`` and ``end``; columns as before."""
    first, last = (dt.datetime.fromisoformat(x).replace(tzinfo=dt.timezone.utc) for x in (start, end))
    days = (last - first).days + 2  # the end instant itself belongs to the window
    offset = int(first.timestamp()) % (days * 86400)
    window = F.window(EVENT, f"{days} days", startTime=f"{offset} seconds")
    # A row is dropped as late only when its window is over, so lateness inside the window costs nothing.
    unique = df.withColumn(_WINDOW, window).dropDuplicates([*keys, _WINDOW])
    return unique.drop(_WINDOW, EVENT)
