"""Logical relations the operators read: the columns each must carry, and their types.

Names are the business relations of a delivery marketplace's warehouse
(orders, support calls, chats, ...).  Operators take DataFrames, never table
names, so any catalog, file layout or streaming source can feed them.

A column's type is one of a few kinds, because warehouses differ in widths
(INT or BIGINT ids, DECIMAL precisions) but a wrong kind changes results
silently: a zoned timestamp moves window ends, a text id joins with nothing,
a double price loses cents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.VarcharType, T.CharType)

# Kind -> the Spark types it takes, and how to say so.
KINDS: dict[str, tuple[tuple[type, ...], str]] = {
    "whole": (_WHOLE, "a whole number"),
    "moment": ((T.TimestampNTZType,), "a timestamp without time zone"),
    "money": ((T.DecimalType,), "a decimal"),
    "amount": ((*_WHOLE, T.DecimalType), "a whole number or a decimal"),
    "money text": ((*_TEXT, T.DecimalType), "text or a decimal"),
    "text": (_TEXT, "text"),
    "flag": ((T.BooleanType,), "a boolean"),
    "key": ((*_WHOLE, *_TEXT), "a whole number or text"),
}


def _columns(**kinds: str) -> dict[str, str]:
    return {column: kind.replace("_", " ") for kind, names in kinds.items() for column in names.split()}


RELATION_TYPES: dict[str, dict[str, str]] = {
    "orders": _columns(
        whole="id user_id order_rank_user zone_id restaurant_id",
        moment="delivered_at created_at",
        text="country_name city_name status",
        money_text="subtotal",
    ),
    "zones": _columns(whole="zone_id core_zone"),
    "calls": _columns(
        key="call_guid primary_agent_id phone_cleaned",
        whole="order_id total_talk_time total_hold_time total_call_duration wrap_up_duration total_handle_time",
        text="origin_lob city_name contact_reason origin_country_name",
        moment="start_timestamp local_start_timestamp local_first_queue_timestamp local_first_answer_timestamp"
               " local_end_timestamp",
        flag="csat_good csat_bad was_answered was_abandoned_under_5_secs was_ans_in_15s was_ans_in_30s was_ans_in_45s"
             " was_ans_in_60s was_ans_in_90s was_ans_in_120s was_ans_in_300s",
    ),
    "chats": _columns(
        key="id agent_ids visitor_id",
        whole="order_id total_message_count",
        text="lob city_name contact_reason",
        moment="chat_timestamp local_chat_timestamp local_first_response_timestamp local_end_timestamp",
        flag="csat_good csat_bad was_abandoned_under_5_secs missed",
    ),
    "chat_event_log": _columns(
        key="chat_id", moment="event_timestamp", text="event_type message_body", flag="is_visitor_event is_agent_event"
    ),
    "emails": _columns(whole="order_id", text="lob", moment="created_at"),
    "claims": _columns(
        whole="order_id", flag="is_self_serve_claim", moment="claim_time", text="claim_reason",
        money="claim_amount_gbp order_total_gbp",
    ),
    "items": _columns(
        whole="order_id", text="mi_menu_category_name mi_name mi_description", flag="mi_alcohol",
        amount="oi_quantity", money="oi_unit_price",
    ),
    "order_list": _columns(whole="orders"),
    "adjustments": _columns(whole="order_id", money="adjustment_cost"),
    "restaurants": _columns(whole="restaurant_id", text="restaurant_name restaurant_company"),
    "ledger": _columns(
        whole="restaurant_id", moment="created_at", money="restaurant_order_net", text="commission_rate"
    ),
}

REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {name: tuple(kinds) for name, kinds in RELATION_TYPES.items()}
RELATIONS = tuple(RELATION_TYPES)


def check_columns(name: str, df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Fail fast (at plan time, no job) when a source lacks one of ``columns`` or has it in a wrong type.

    ``columns`` are those about to be read; by default all of the relation.
    """
    kinds = RELATION_TYPES[name]
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    wanted = list(columns) if columns is not None else list(kinds)
    missing = [c for c in wanted if c.lower() not in have]
    if missing:
        raise ValueError(f"relation {name!r} lacks columns {missing}")
    wrong = [
        f"{c} is {have[c.lower()].simpleString()}, must be {KINDS[kinds[c]][1]}"
        for c in wanted if not isinstance(have[c.lower()], KINDS[kinds[c]][0])
    ]
    if wrong:
        raise TypeError(f"relation {name!r}: " + "; ".join(wrong))
    return df
