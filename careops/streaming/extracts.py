"""Incremental extracts with Structured Streaming.

The call and chat extracts (B09, B10) are filters and projections, so the
batch operators apply unchanged to a streaming DataFrame: each micro-batch
of newly landed source files is filtered and appended to the sink.  The
contacted-order set (B03) is kept incrementally by deduplicating order ids;
given a lateness, its state ends with the contact window (``state.once_in``).
Progress lives in the checkpoint location (shared storage), so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from careops.functions.predicates import ts_between
from careops.operators import contacts
from careops.streaming.state import EVENT, marked, once_in


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files landing under ``path`` as a stream (schema given up front)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def _sink(df: DataFrame, sink: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def stream_call_extract(
    calls: DataFrame,
    sink: str,
    checkpoint: str,
    start: str,
    end: str,
    excluded_dates: Sequence[str] = (),
    lob: str = "Customer",
    available_now: bool = True,
) -> StreamingQuery:
    """B09 over a stream of call records, appended to ``sink``."""
    return _sink(contacts.call_extract(calls, start, end, excluded_dates, lob), sink, checkpoint, available_now)


def stream_chat_extract(
    chats: DataFrame,
    sink: str,
    checkpoint: str,
    start: str,
    end: str,
    excluded_dates: Sequence[str] = (),
    lob: str = "Customer",
    available_now: bool = True,
) -> StreamingQuery:
    """B10 over a stream of chat records, appended to ``sink``."""
    return _sink(contacts.chat_extract(chats, start, end, excluded_dates, lob), sink, checkpoint, available_now)


def contacted_orders_stream(
    calls: DataFrame,
    chats: DataFrame,
    emails: DataFrame,
    start: str,
    end: str,
    lob: str = "Customer",
    lateness: str | None = None,
) -> DataFrame:
    """B03 as a streaming DataFrame: each contacted order id emitted once.

    The state holds the order ids contacted between ``start`` and ``end``.
    Without ``lateness`` it stays for ever, and records count whenever they
    arrive.  With it (``"2 days"``) it is dropped once all three streams have
    come that far past the window; a record that arrives still later is not
    counted.
    """
    timed = [EVENT] if lateness else []

    def pick(df: DataFrame, lob_col: str, ts_col: str) -> DataFrame:
        if lateness:  # a filter on the event time itself stays above the watermark, which every row moves
            df, ts_col = marked(df, ts_col, lateness), timed[0]
        return df.filter(
            (F.col(lob_col) == lob) & F.col("order_id").isNotNull() & ts_between(ts_col, start, end)
        ).select("order_id", *timed)

    contacts_ = (
        pick(calls, "origin_lob", "start_timestamp")
        .unionByName(pick(chats, "lob", "chat_timestamp"))
        .unionByName(pick(emails, "lob", "created_at"))
    )
    return once_in(contacts_, ["order_id"], start, end) if lateness else contacts_.dropDuplicates(["order_id"])
