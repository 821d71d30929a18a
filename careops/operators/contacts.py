"""Support-contact extracts: calls, chats and chat transcripts.

Scale notes:
* the extracts are filter + projection: the date window and flags reach
  the Parquet scan as pushed filters, only the projected columns are read;
* the transcript counts messages by chat and instant and numbers these
  counts, without text, over ranges; the messages then meet them in one
  exchange by (chat, instant), which is the only one that carries text, so
  one chat with a third of all messages is still spread over many tasks;
* ``multi_message_chats`` counts messages per chat with a partial
  aggregate and expands the chat row afterwards instead of joining the
  chat row to every message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careops.functions.materialize import written
from careops.functions.ordering import row_number_within, running_total_within
from careops.functions.predicates import exclude_dates, is_false, is_true, ts_between
from careops.functions.rows import replicate_rows

CALL_COLUMNS = (
    "call_id", "order_id", "origin_lob", "local_start_timestamp",
    "local_first_queue_timestamp", "local_first_answer_timestamp",
    "local_end_timestamp", "total_talk_time", "total_hold_time",
    "total_call_duration", "wrap_up_duration", "total_handle_time",
    "primary_agent_id", "customer_city", "customer_phone", "contact_reason",
    "csat_good", "csat_bad",
)

CHAT_COLUMNS = (
    "chat_id", "order_id", "lob", "local_chat_timestamp",
    "local_first_response_timestamp", "local_end_timestamp", "agent_ids",
    "customer_city", "customer_id", "contact_reason", "csat_good", "csat_bad",
    "total_message_count",
)


def call_extract(
    calls: DataFrame,
    start: str,
    end: str,
    excluded_dates: Sequence[str] = (),
    lob: str = "Customer",
    exclude: str = "instant",
) -> DataFrame:
    """Answered, not-abandoned customer calls in the window (18 columns)."""
    renames = {"call_id": "call_guid", "customer_city": "city_name", "customer_phone": "phone_cleaned"}
    return calls.filter(
        ts_between("local_start_timestamp", start, end)
        & exclude_dates("local_start_timestamp", excluded_dates, exclude)
        & is_true("was_answered")
        & is_false("was_abandoned_under_5_secs")
        & (F.col("origin_lob") == lob)
    ).select(*[F.col(renames.get(c, c)).alias(c) for c in CALL_COLUMNS])


def chat_extract(
    chats: DataFrame,
    start: str,
    end: str,
    excluded_dates: Sequence[str] = (),
    lob: str = "Customer",
    exclude: str = "instant",
) -> DataFrame:
    """Answered (not missed), not-abandoned customer chats (13 columns)."""
    renames = {"chat_id": "id", "customer_city": "city_name", "customer_id": "visitor_id"}
    return chats.filter(
        ts_between("chat_timestamp", start, end)
        & exclude_dates("chat_timestamp", excluded_dates, exclude)
        & is_false("was_abandoned_under_5_secs")
        & is_false("missed")
        & (F.col("lob") == lob)
    ).select(*[F.col(renames.get(c, c)).alias(c) for c in CHAT_COLUMNS])


MESSAGE_ORDER = ("event_timestamp", "message_body", "is_visitor_event", "is_agent_event")


# Messages of one chat at one instant that one task sorts; beyond it they are numbered over ranges.
INSTANT_MESSAGES = 100_000


def chat_transcript(event_log: DataFrame, chats: DataFrame, instant_messages: int = INSTANT_MESSAGES) -> DataFrame:
    """Messages of the selected chats, split by speaker, numbered in time.

    Only ``chat.msg`` events are kept, before numbering.  Ties on the event
    time are broken by the message text, then the speaker flags, so the
    numbering is deterministic; messages without a time come first.  A chat
    listed k times has each message k times, with consecutive numbers.

    A message's number is the count of its chat's messages at earlier
    instants plus its place among those of its own.  The counts are narrow
    rows; a message's text moves once, to its (chat, instant).  Only chats
    listed repeatedly, and instants of more than ``instant_messages``, take
    the longer way over ranges of the text itself.
    """
    at, kind = F.col("event_timestamp"), event_log.schema["event_timestamp"].dataType
    # Plain equality on (timed, instant) lets the join's exchange serve the window too; a NULL time is one instant.
    msgs = event_log.filter(F.col("event_type") == "chat.msg").select(
        "chat_id", at.isNotNull().alias("_timed"), F.coalesce(at, F.lit("1970-01-01").cast(kind)).alias("_instant"),
        *MESSAGE_ORDER[1:],
    )
    instant = ["chat_id", "_timed", "_instant"]
    ids = chats.groupBy(F.col("chat_id").alias("_chat")).agg(F.count(F.lit(1)).alias("_listed"))
    counts = msgs.groupBy(*instant).agg(F.count(F.lit(1)).alias("_messages"))
    counts = counts.join(ids, F.col("chat_id") == F.col("_chat")).select(
        *instant, "_messages", "_listed", (F.col("_messages") * F.col("_listed")).alias("_rows")
    )
    instants = written(
        running_total_within(counts, ["chat_id"], instant[1:], "_rows", "_upto").select(
            *instant, "_messages", "_listed", (F.col("_upto") - F.col("_rows")).alias("_before"))
    )
    plain = (F.col("_listed") == 1) & (F.col("_messages") <= instant_messages)
    place = F.row_number().over(Window.partitionBy(*instant).orderBy(*MESSAGE_ORDER[1:]))
    numbered = msgs.join(instants.filter(plain).select(*instant, "_before"), instant).select(
        *msgs.columns, (F.col("_before") + place).alias("_number")
    )
    others = instants.filter(~plain)
    if not others.isEmpty():
        rest = row_number_within(
            msgs.join(others.select(*instant, "_before", "_listed"), instant), instant, MESSAGE_ORDER[1:], out="_place")
        first = F.col("_before") + (F.col("_place") - 1) * F.col("_listed") + 1
        rest = replicate_rows(rest.select(*msgs.columns, first.alias("_first"), "_listed"), "_listed", index_col="_k")
        numbered = numbered.union(rest.select(*msgs.columns, F.col("_first") + F.col("_k")))
    return numbered.select(
        "chat_id",
        F.when(is_true("is_visitor_event"), F.col("message_body")).alias("customer_chat"),
        F.when(is_true("is_agent_event"), F.col("message_body")).alias("agent_chat"),
        F.col("_number").cast("int").alias("chat_cum"),
    )


def chat_messages(event_log: DataFrame, chats: DataFrame) -> DataFrame:
    """The chat ids of the transcript's rows, without text or numbering."""
    msgs = event_log.filter(F.col("event_type") == "chat.msg").select("chat_id")
    return msgs.join(chats.select(F.col("chat_id").alias("_chat")), F.col("chat_id") == F.col("_chat")).drop("_chat")


def multi_message_chats(chats: DataFrame, messages: DataFrame, mode: str = "rows") -> DataFrame:
    """Chats with more than one message; ``messages`` has a ``chat_id`` per transcript row.

    ``rows`` (faithful): the warehouse joins each chat to every transcript
    row after its first, so a chat with n messages appears n − 1 times.
    ``distinct``: each such chat once.
    """
    if mode not in ("rows", "distinct"):
        raise ValueError(f"unknown mode {mode!r}")
    extra = (
        messages.groupBy(F.col("chat_id").alias("_chat"))
        .agg((F.count(F.lit(1)) - 1).alias("_copies"))
        .filter(F.col("_copies") > 0)
    )
    if mode == "distinct":
        return chats.join(extra, chats["chat_id"] == extra["_chat"], "left_semi")
    joined = chats.join(extra, chats["chat_id"] == extra["_chat"])
    return replicate_rows(joined.select(*chats.columns, "_copies"), "_copies")
