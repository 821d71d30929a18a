"""First-time-customer retention by support contact and self-service.

Pipeline: first orders in a window get a cohort number; their order ids are
flagged when the customer contacted support (call, chat or email) or made a
self-serve claim; later orders within ``horizon_weeks`` give, per user, the
weeks in which they came back; reports count distinct users per cohort and
week.

Scale notes:
* cohort selection is a filter on ``order_rank_user = 1`` plus the window,
  pushed into the orders scan;
* contact sources are deduplicated with a partial (map-side) aggregate;
* self-serve claims are pre-aggregated to one ``(order_id, count)`` row per
  order before the flag join, so a hot order never moves its duplicates;
* the activity join reads one row per customer, an array of order days
  combined map-side from a bit mask per window of days, so a user with
  millions of orders sends a few small rows and the join multiplies nothing;
* a cohort row's return weeks are a bit mask (bit w - 1 for week w).  Reports
  count users from masks: one row per user and cohort, no distinct over
  (cohort, week, user).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops.functions.predicates import is_true, ts_between
from careops.functions.rows import replicate_rows

FLAGS = ("cs_contact", "self_serve")


def first_orders(orders: DataFrame, start: str, end: str) -> DataFrame:
    return orders.filter((F.col("order_rank_user") == 1) & ts_between("delivered_at", start, end))


def first_order_cohort_day(orders: DataFrame, start: str, end: str) -> DataFrame:
    """First orders in ``[start, end]``; cohort = day of month."""
    return first_orders(orders, start, end).select(
        "user_id",
        "id",
        F.col("delivered_at").alias("first_delivery_date"),
        F.dayofmonth("delivered_at").alias("cohort"),
    )


def first_order_cohort_week(
    orders: DataFrame,
    start: str,
    end: str,
    week_offset: int,
    zones: DataFrame | None = None,
    countries: Sequence[str] | None = None,
    cities: Sequence[str] | None = None,
) -> DataFrame:
    """First orders; cohort = ISO week of the Monday-truncated date − offset.

    ``zones``: keep orders in a core zone (inner join, ``core_zone = 1``).
    ``countries`` / ``cities``: keep orders whose country OR city is listed.
    The cohort number is only meaningful inside one ISO year.
    """
    df = first_orders(orders, start, end)
    if zones is not None:
        core = zones.filter(F.col("core_zone") == 1).select("zone_id")
        df = df.join(core, "zone_id")
    if countries is not None or cities is not None:
        df = df.filter(
            F.col("country_name").isin(list(countries or []))
            | F.col("city_name").isin(list(cities or []))
        )
    week = F.weekofyear(F.date_trunc("week", F.col("delivered_at")))
    return df.select(
        "user_id",
        "id",
        F.col("delivered_at").alias("first_delivery_date"),
        (week - F.lit(week_offset)).alias("cohort"),
    )


def contacted_orders(
    calls: DataFrame,
    chats: DataFrame,
    emails: DataFrame,
    start: str,
    end: str,
    lob: str = "Customer",
) -> DataFrame:
    """Distinct order ids with a call, chat or email in the window."""

    def pick(df: DataFrame, lob_col: str, ts_col: str) -> DataFrame:
        return df.filter(
            (F.col(lob_col) == lob) & F.col("order_id").isNotNull() & ts_between(ts_col, start, end)
        ).select("order_id")

    return (
        pick(calls, "origin_lob", "start_timestamp")
        .unionAll(pick(chats, "lob", "chat_timestamp"))
        .unionAll(pick(emails, "lob", "created_at"))
        .distinct()
    )


def self_serve_orders(claims: DataFrame, start: str, end: str) -> DataFrame:
    """Order id of every self-serve claim in the window (not deduplicated)."""
    return claims.filter(is_true("is_self_serve_claim") & ts_between("claim_time", start, end)).select(
        "order_id"
    )


def cohort_contact_flags(
    cohorts: DataFrame,
    contacts: DataFrame,
    self_serve: DataFrame | None = None,
    keep_duplicates: bool = True,
) -> DataFrame:
    """Cohort rows with 0/1 ``cs_contact`` (and ``self_serve``) flags.

    The warehouse left-joins the non-distinct self-serve list, so a first
    order with k self-serve claims appears k times; ``keep_duplicates``
    reproduces that (the default).  Downstream activity is DISTINCT, so the
    compositions pass ``keep_duplicates=False``.
    """
    contact_ids = contacts.select(F.col("order_id").alias("_cid")).distinct()
    df = cohorts.join(contact_ids, cohorts["id"] == contact_ids["_cid"], "left")
    out = [
        "user_id",
        F.col("id").alias("first_order_id"),
        F.to_date("first_delivery_date").alias("first_order_date"),
        "cohort",
        F.when(F.col("_cid").isNull(), 0).otherwise(1).alias("cs_contact"),
    ]
    if self_serve is None:
        return df.select(*out)

    claims = self_serve.filter(F.col("order_id").isNotNull()).groupBy(
        F.col("order_id").alias("_sid")
    ).agg(F.count(F.lit(1)).alias("_claims"))
    df = df.join(claims, df["id"] == claims["_sid"], "left")
    out.append(F.when(F.col("_sid").isNull(), 0).otherwise(1).alias("self_serve"))
    if not keep_duplicates:
        return df.select(*out)
    copies = F.coalesce(F.col("_claims"), F.lit(1)).alias("_copies")
    return replicate_rows(df.select(*out, copies), "_copies")


def return_weeks(
    flags: DataFrame,
    orders: DataFrame,
    horizon_weeks: int = 12,
    exclusive: bool = False,
    cohort_window: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per ``(user_id, cohort, flags...)`` with ``weeks``, the bit mask of return weeks (bit w - 1: week w).

    A return order has a delivery date strictly after the first order date
    and at most ``horizon_weeks`` weeks after it; its week is
    ``ceil(days / 7)`` (1..horizon).  Users who never came back do not appear
    (the warehouse's WHERE turns its LEFT JOIN into an inner one).
    ``exclusive`` drops users flagged both ways.  ``cohort_window`` (the
    first-order window) lets the orders scan be cut to the only dates that
    can match.

    Both sides are combined to one row per user before their only exchange
    (different flag rows; different order days), the join multiplies nothing,
    and the masks need no further exchange.
    """
    if not 1 <= horizon_weeks <= 62:
        raise ValueError("a mask holds 1 to 62 weeks")
    flag_cols = [c for c in FLAGS if c in flags.columns]
    horizon_days = 7 * horizon_weeks
    # A flag row repeated many times (B05 keeps claim multiplicity) is one entry of its user's set.
    cc = flags.filter(F.col("user_id").isNotNull())
    if exclusive:
        cc = cc.filter(sum(F.col(c) for c in flag_cols) < 2)
    users = cc.groupBy("user_id").agg(
        F.collect_set(F.struct("cohort", *flag_cols, "first_order_date")).alias("_flags")
    )

    day = F.to_date("delivered_at")
    o = orders.select("user_id", "delivered_at")
    if cohort_window is not None:
        lo = F.to_date(F.lit(cohort_window[0]).cast("timestamp_ntz"))
        hi = F.date_add(F.to_date(F.lit(cohort_window[1]).cast("timestamp_ntz")), horizon_days)
        o = o.filter((day > lo) & (day <= hi))
    days = o.filter(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("_uid")).agg(
        F.collect_set(day).alias("_days")
    )

    one = F.lit(1).cast("long")

    def week_bit(mask: Column, d: Column) -> Column:
        gap = F.datediff(d, F.col("_f.first_order_date"))
        week = F.floor((gap + 6) / 7).cast("int")  # ceil(gap / 7) of a positive gap
        bit = F.call_function("shiftleft", one, week - 1)
        return F.when((gap > 0) & (gap <= horizon_days), mask.bitwiseOR(bit)).otherwise(mask)

    joined = users.join(days, users["user_id"] == days["_uid"]).select(
        "user_id", "_days", F.explode("_flags").alias("_f")
    )
    masks = joined.select(
        "user_id", *[F.col(f"_f.{c}").alias(c) for c in ("cohort", *flag_cols)],
        F.aggregate("_days", F.lit(0).cast("long"), week_bit).alias("_weeks"),
    ).filter(F.col("_weeks") != 0)
    return masks.groupBy("user_id", "cohort", *flag_cols).agg(F.bit_or("_weeks").alias("weeks"))


def week_bits(weeks: str, horizon_weeks: int) -> Column:
    """The weeks of a mask, as an array of numbers."""
    return F.filter(
        F.sequence(F.lit(1).cast("long"), F.lit(horizon_weeks).cast("long")),
        lambda w: F.call_function("shiftright", F.col(weeks), (w - 1).cast("int")).bitwiseAND(1) == 1,
    )


def retention_activity(
    flags: DataFrame,
    orders: DataFrame,
    horizon_weeks: int = 12,
    exclusive: bool = False,
    cohort_window: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct ``(user_id, cohort, flags..., week_round)`` of return orders (see ``return_weeks``)."""
    masks = return_weeks(flags, orders, horizon_weeks, exclusive, cohort_window)
    rest = [c for c in masks.columns if c != "weeks"]
    return masks.select(*rest, F.explode(week_bits("weeks", horizon_weeks)).alias("week_round"))


def _users(masks: DataFrame, flag: str, value: int) -> DataFrame:
    """``user_id, cohort, weeks`` for one flag value: a user counts once in a cohort."""
    return masks.filter(F.col(flag) == value).groupBy("user_id", "cohort").agg(F.bit_or("weeks").alias("weeks"))


def retained_users(masks: DataFrame, flag: str, value: int, horizon_weeks: int = 12) -> DataFrame:
    """Distinct users per (cohort, week_round) for one flag value, from ``return_weeks``.

    Each week is one sum over the masks, combined before the exchange.
    """
    weeks = range(1, horizon_weeks + 1)
    bit = lambda w: F.call_function("shiftright", F.col("weeks"), F.lit(w - 1)).bitwiseAND(1)
    sums = _users(masks, flag, value).groupBy("cohort").agg(*[F.sum(bit(w)).alias(f"_w{w}") for w in weeks])
    counts = F.array(*[
        F.struct(F.col(f"_w{w}").alias("retained_users"), F.lit(w).cast("long").alias("week_round")) for w in weeks
    ])
    return (
        sums.select("cohort", F.explode(counts).alias("_c"))
        .select("cohort", "_c.retained_users", "_c.week_round")
        .filter(F.col("retained_users") > 0)
        .orderBy("cohort", "week_round")
    )


def cohort_totals(masks: DataFrame, flag: str, value: int, with_cohort: bool = True) -> DataFrame:
    """Distinct returning users per cohort for one flag value, from ``return_weeks``.

    Counts users who came back at least once, not the cohort size.
    ``with_cohort=False`` drops the cohort column (still grouped by it).
    """
    df = _users(masks, flag, value).groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_total"))
    return df.select("cohort_total", "cohort").orderBy("cohort") if with_cohort else df.select("cohort_total")
