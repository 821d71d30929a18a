"""Service-level reports: answer-time buckets and late-order claims.

Both end in a global aggregate: every task pre-aggregates its rows, a single
final task merges one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops.functions.predicates import is_false, is_true, not_in, ts_between

# Answer-time thresholds (seconds) of the cumulative flags.
ANSWER_THRESHOLDS = (15, 30, 45, 60, 90, 120, 300)

# Claim reasons of a late order.
LATE_ORDER_REASONS = ("late live order", "late order request credit")


def _bucket_flags() -> dict[str, Column]:
    """Exclusive buckets from the cumulative ``was_ans_in_<t>s`` flags.

    ``answered_<t>`` needs every flag below ``t`` False and every flag from
    ``t`` up True; ``answered_over_300`` needs all False.  NULL flags or a
    non-monotone set fall into no bucket.
    """
    flags = [f"was_ans_in_{t}s" for t in ANSWER_THRESHOLDS]

    def bucket(first_true: int) -> Column:
        cond = F.lit(True)
        for i, f in enumerate(flags):
            cond = cond & (is_true(f) if i >= first_true else is_false(f))
        return F.when(cond, 1).otherwise(0)

    out = {"answered_over_300": bucket(len(flags))}
    for i in reversed(range(len(flags))):
        out[f"answered_{ANSWER_THRESHOLDS[i]}"] = bucket(i)
    return out


BUCKETS = ("answered_15", "answered_30", "answered_45", "answered_60",
           "answered_90", "answered_120", "answered_300", "answered_over_300")


def good_csat_calls(
    calls: DataFrame,
    start: str,
    end: str,
    excluded_countries: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Answered good-CSAT calls in the window with their bucket flags (not deduplicated), and the columns ``keep``."""
    buckets = _bucket_flags()
    good = F.when(is_true("csat_good"), 1).otherwise(0).alias("good")
    bad = F.when(is_true("csat_bad"), 1).otherwise(0).alias("bad")
    return calls.filter(
        not_in("origin_country_name", excluded_countries)
        & is_true("csat_good")
        & is_true("was_answered")
        & ts_between("start_timestamp", start, end)
    ).select("call_guid", *[c.alias(n) for n, c in buckets.items()], good, bad, *keep)


def bucket_totals(per_call: DataFrame) -> DataFrame:
    """``call_count`` and the bucket sums over deduplicated per-call rows."""
    return per_call.agg(
        F.count("call_guid").alias("call_count"),
        *[F.sum(n).cast("bigint").alias(n) for n in BUCKETS],
    )


def answer_time_buckets(
    calls: DataFrame,
    start: str,
    end: str,
    excluded_countries: Sequence[str] = (),
) -> DataFrame:
    """Call count and exclusive answer-time bucket sums for good-CSAT calls.

    Per-call rows are deduplicated over the call id and all flags (a call
    with two flag sets counts twice, as in the warehouse).
    """
    return bucket_totals(good_csat_calls(calls, start, end, excluded_countries).distinct())


def claim_cost_summary(
    claims: DataFrame,
    as_of: str | None,
    days: int = 90,
    reasons: Sequence[str] = LATE_ORDER_REASONS,
    amount: int | str = 15,
) -> DataFrame:
    """Fixed-amount late-order claims after ``as_of − days``: totals.

    ``order_total`` counts orders with a non-NULL id; the sums include the
    claims without an order id.  ``as_of`` (a date) pins the reference day;
    None uses the current date, as the warehouse query does.
    """
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    cutoff = F.date_sub(today, days).cast("timestamp_ntz")
    per_order = (
        claims.filter(
            (F.col("claim_time") > cutoff)
            & F.col("claim_reason").isin(list(reasons))
            & (F.col("claim_amount_gbp") == F.lit(amount).cast("decimal(10,2)"))
        )
        .groupBy("order_id")
        .agg(
            F.sum("claim_amount_gbp").alias("claim_amount_gbp"),
            F.sum("order_total_gbp").alias("order_total_gbp"),
        )
    )
    return per_order.agg(
        F.count("order_id").alias("order_total"),
        F.sum("claim_amount_gbp").cast("decimal(18,2)").alias("claim_amount_gbp_total"),
        F.sum("order_total_gbp").cast("decimal(18,2)").alias("order_total_gbp_total"),
    )
