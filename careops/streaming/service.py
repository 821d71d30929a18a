"""B13 as a running total over arriving call records.

Per-call rows are deduplicated and summed by a global streaming aggregate;
each trigger emits the complete, current totals.  The deduplication holds the
calls of the window; given a lateness, it ends with the window
(``state.once_in``), and only the totals' one row stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.operators.service import BUCKETS, bucket_totals, good_csat_calls
from careops.streaming.state import EVENT, marked, once_in


def answer_time_buckets_stream(
    calls: DataFrame,
    start: str,
    end: str,
    excluded_countries: Sequence[str] = (),
    lateness: str | None = None,
) -> DataFrame:
    """Streaming DataFrame of the B13 totals (write it with output mode ``complete``).

    Without ``lateness`` calls count whenever they arrive and their state
    stays for ever; with it calls that arrive so long after the window are
    not counted and the state is dropped.
    """
    keys = ["call_guid", *BUCKETS, "good", "bad"]
    if lateness is None:
        return bucket_totals(good_csat_calls(calls, start, end, excluded_countries).dropDuplicates(keys))
    timed = marked(calls, "start_timestamp", lateness)
    # The window's filter on the event time itself stays above the watermark, which every row moves.
    timed = timed.withColumn("start_timestamp", F.col(EVENT))
    per_call = good_csat_calls(timed, start, end, excluded_countries, keep=[EVENT])
    return bucket_totals(once_in(per_call, keys, start, end))
