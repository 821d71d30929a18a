"""End-to-end analyses built from the operators.

Each function takes ``Sources`` and ``Params`` and returns a DataFrame.  A few
run small jobs while building: checkpoints of relations that several
branches read (``careops.functions.materialize``); everything else is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from careops.functions.materialize import written
from careops.operators import alcohol, commission, contacts, payments, retention, service
from careops.plans.params import Params
from careops.sources.catalog import Sources


# What the analyses read of each relation; only these columns are checked and scanned.
_FIRST_ORDERS = ("user_id", "id", "delivered_at", "order_rank_user")
_RETURNS = ("user_id", "delivered_at")
_SETTLED = ("id", "created_at", "restaurant_id", "subtotal", "status")


def _use(src: Sources, name: str, *columns: str) -> DataFrame:
    return src.use(name, *columns) if isinstance(src, Sources) else getattr(src, name)


# ----------------------------------------------------------------- retention
def week_cohorts(src: Sources, p: Params, variant: str = "plain") -> DataFrame:
    start, end = p.week_window
    if variant == "plain":
        return retention.first_order_cohort_week(_use(src, "orders", *_FIRST_ORDERS), start, end, p.week_offset)
    if variant == "core_zone":
        return retention.first_order_cohort_week(
            _use(src, "orders", *_FIRST_ORDERS, "zone_id"), start, end, p.core_zone_week_offset, zones=src.zones
        )
    if variant == "geo":
        return retention.first_order_cohort_week(
            _use(src, "orders", *_FIRST_ORDERS, "country_name", "city_name"), start, end, p.week_offset,
            countries=p.geo_countries, cities=p.geo_cities
        )
    raise ValueError(variant)


def day_cohorts(src: Sources, p: Params) -> DataFrame:
    return retention.first_order_cohort_day(_use(src, "orders", *_FIRST_ORDERS), *p.day_window)


def contacted(src: Sources, p: Params, window: tuple[str, str] | None = None) -> DataFrame:
    return retention.contacted_orders(
        _use(src, "calls", "order_id", "origin_lob", "start_timestamp"),
        _use(src, "chats", "order_id", "lob", "chat_timestamp"),
        _use(src, "emails", "order_id", "lob", "created_at"),
        *(window or p.contact_window), lob=p.lob,
    )


def self_served(src: Sources, p: Params) -> DataFrame:
    return retention.self_serve_orders(
        _use(src, "claims", "order_id", "is_self_serve_claim", "claim_time"), *p.contact_window)


def flags(
    src: Sources,
    p: Params,
    cohorts: DataFrame,
    two_flags: bool,
    keep_duplicates: bool = True,
    contact_window: tuple[str, str] | None = None,
) -> DataFrame:
    return retention.cohort_contact_flags(
        cohorts,
        contacted(src, p, contact_window),
        self_served(src, p) if two_flags else None,
        keep_duplicates=keep_duplicates,
    )


def activity(
    src: Sources,
    p: Params,
    cohorts: DataFrame,
    window: tuple[str, str],
    two_flags: bool,
    exclusive: bool = False,
    contact_window: tuple[str, str] | None = None,
    masks: bool = False,
) -> DataFrame:
    """B06 rows, or with ``masks`` one row per user with the mask of return weeks, which the reports count from."""
    f = flags(src, p, cohorts, two_flags, keep_duplicates=False, contact_window=contact_window)
    build = retention.return_weeks if masks else retention.retention_activity
    return build(f, _use(src, "orders", *_RETURNS), p.horizon_weeks, exclusive=exclusive, cohort_window=window)


# The four original retention analyses: (retained report, totals report).
def retention_day(src: Sources, p: Params) -> tuple[DataFrame, DataFrame]:
    act = activity(
        src, p, day_cohorts(src, p), p.day_window, two_flags=False, contact_window=p.day_contact_window,
        masks=True,
    )
    return (
        retention.retained_users(act, "cs_contact", 0, p.horizon_weeks),
        retention.cohort_totals(act, "cs_contact", 0),
    )


def retention_core_zone(src: Sources, p: Params) -> tuple[DataFrame, DataFrame]:
    act = activity(src, p, week_cohorts(src, p, "core_zone"), p.week_window, two_flags=False, masks=True)
    return (
        retention.retained_users(act, "cs_contact", 1, p.horizon_weeks),
        retention.cohort_totals(act, "cs_contact", 0),
    )


def retention_self_serve(src: Sources, p: Params) -> tuple[DataFrame, DataFrame]:
    act = activity(src, p, week_cohorts(src, p, "plain"), p.week_window, two_flags=True, exclusive=True, masks=True)
    return (
        retention.retained_users(act, "self_serve", 1, p.horizon_weeks),
        retention.cohort_totals(act, "self_serve", 1),
    )


def retention_geo(src: Sources, p: Params) -> tuple[DataFrame, DataFrame]:
    act = activity(src, p, week_cohorts(src, p, "geo"), p.week_window, two_flags=True, masks=True)
    return (
        retention.retained_users(act, "cs_contact", 0, p.horizon_weeks),
        retention.cohort_totals(act, "cs_contact", 1, with_cohort=False),
    )


# ------------------------------------------------------------------ contacts
def calls_extract(src: Sources, p: Params) -> DataFrame:
    return contacts.call_extract(src.calls, *p.extract_window, p.extract_excluded_dates, p.lob)


def chats_extract(src: Sources, p: Params) -> DataFrame:
    return contacts.chat_extract(src.chats, *p.extract_window, p.extract_excluded_dates, p.lob)


def transcript(src: Sources, p: Params) -> DataFrame:
    return contacts.chat_transcript(src.chat_event_log, chats_extract(src, p))


def multi_message(src: Sources, p: Params, mode: str = "rows") -> DataFrame:
    chats = chats_extract(src, p)
    return contacts.multi_message_chats(chats, contacts.chat_messages(src.chat_event_log, chats), mode)


# ------------------------------------------------------------------- service
def answer_buckets(src: Sources, p: Params) -> DataFrame:
    return service.answer_time_buckets(src.calls, *p.csat_window, p.csat_excluded_countries)


def claim_costs(src: Sources, p: Params) -> DataFrame:
    return service.claim_cost_summary(
        src.claims, p.claims_as_of, p.claims_days, amount=p.claims_amount
    )


# ------------------------------------------------------------------ payments
def true_positives(src: Sources, p: Params) -> DataFrame:
    return alcohol.alcohol_true_positives(src.items, src.order_list, p.misflagged_categories)


def false_negatives(src: Sources, p: Params) -> DataFrame:
    return alcohol.alcohol_false_negatives(
        src.items, src.order_list, true_positives(src, p), p.not_alcohol_categories, p.not_alcohol_prefix
    )


def alcohol_totals(src: Sources, p: Params) -> DataFrame:
    return alcohol.alcohol_totals_one_scan(
        src.items, src.order_list, p.misflagged_categories, p.not_alcohol_categories, p.not_alcohol_prefix
    )


def adjustments(src: Sources, p: Params) -> DataFrame:
    return payments.order_adjustments(src.adjustments, src.order_list)


def orders_alcohol(src: Sources, p: Params) -> DataFrame:
    return payments.orders_with_alcohol(
        src.order_list, adjustments(src, p), _use(src, "orders", *_SETTLED), alcohol_totals(src, p), src.restaurants
    )


def settled(src: Sources, p: Params) -> DataFrame:
    return payments.settled_orders(src.order_list, _use(src, "orders", *_SETTLED), src.restaurants)


# The commission match asks nothing about alcohol or adjustments, so items and adjustments are not read for it.
def commission_combined(src: Sources, p: Params) -> DataFrame:
    return commission.commission_combined(settled(src, p), src.ledger)


def commission_tier(src: Sources, p: Params, tier: int) -> DataFrame:
    return commission.commission_tier(settled(src, p), src.ledger, tier)


def payment_adjustment(src: Sources, p: Params) -> DataFrame:
    # Read by the commission match and by the final join: the one relation that is written.
    oa = written(orders_alcohol(src, p))
    return payments.payment_adjustment(commission.commission_combined(oa, src.ledger, materialize=False), oa)
