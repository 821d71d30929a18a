"""Invariants on the sf0.001 results, plan-shape checks and determinism."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from careops.functions.materialize import recorded
from careops.plans import compositions as C
from careops.plans import registry
from careops.plans.params import TESTDATA
from careops.sources.testdata import testdata_sources
from tests.conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def src(spark):
    return testdata_sources(spark, SF_SMALL)


def test_tiers_partition_the_orders(spark, src):
    oa = C.orders_alcohol(src, TESTDATA)
    comb = C.commission_combined(src, TESTDATA)
    n_orders = oa.select("orders").distinct().count()
    per_tier = [C.commission_tier(src, TESTDATA, t).count() for t in (1, 2, 3, 4)]
    assert sum(per_tier) == n_orders == comb.count()
    assert comb.select("orders").distinct().count() == n_orders


def test_buckets_cover_monotone_calls(spark, src):
    r = C.answer_buckets(src, TESTDATA).collect()[0].asDict()
    # the test calls have monotone flags and no NULLs, so every call is in one bucket
    assert r["call_count"] == sum(v for k, v in r.items() if k.startswith("answered"))


def test_week_round_range_and_exclusive(spark, src):
    act = E.queries()["retention_activity"](spark, SF_SMALL)
    weeks = {r.week_round for r in act.select("week_round").distinct().collect()}
    assert weeks and weeks <= set(range(1, TESTDATA.horizon_weeks + 1))
    ex = E.queries()["retention_activity_exclusive"](spark, SF_SMALL)
    assert ex.filter((F.col("cs_contact") == 1) & (F.col("self_serve") == 1)).count() == 0


def test_multi_message_rows_equal_sum_n_minus_one(spark, src):
    tr = C.transcript(src, TESTDATA)
    expected = tr.groupBy("chat_id").count().agg(F.sum(F.col("count") - 1)).collect()[0][0] or 0
    assert C.multi_message(src, TESTDATA, "rows").count() == expected


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_python_udf(spark, name):
    # The relations written while the query is built count as well as the final plan.
    with recorded() as cut:
        df = E.queries()[name](spark, SF_SMALL)
    plan = "\n".join(map(_plan, [*cut, df] if name in registry.queries() else [df]))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_extract_pushes_filters_and_prunes_columns(spark):
    from careops.operators.contacts import chat_extract

    chats = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("order_id"), F.lit("Customer").alias("lob"),
        F.col("ts").alias("chat_timestamp"), F.col("ts").alias("local_chat_timestamp"),
        F.col("ts").alias("local_first_response_timestamp"), F.col("ts").alias("local_end_timestamp"),
        F.lit("a").alias("agent_ids"), F.lit("c").alias("city_name"), F.col("user_id").alias("visitor_id"),
        F.lit("r").alias("contact_reason"), F.lit(True).alias("csat_good"), F.lit(False).alias("csat_bad"),
        F.lit(1).alias("total_message_count"), F.lit(False).alias("was_abandoned_under_5_secs"),
        F.lit(False).alias("missed"),
    )
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        chat_extract(chats, "2024-01-01", "2024-01-31", ["2024-01-16"]).explain("formatted")
    plan = buf.getvalue()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(ts," in pushed and "LessThanOrEqual(ts," in pushed
    assert "Not(EqualTo(ts," in pushed  # the excluded instant
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_same_result_with_one_and_many_partitions(spark):
    names = ["commission_combined", "chat_transcript", "retained_users", "alcohol_order_totals"]
    before = {n: rows(E.queries()[n](spark, SF_SMALL)) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        after = {n: rows(E.queries()[n](spark, SF_SMALL)) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after


def test_first_orders_limit_before_shuffle(spark):
    plan = _plan(E.queries()["first_order_cohort_week"](spark, SF_SMALL))
    assert "row_number(), 1, Partial" in plan  # top-1 per customer before the exchange


def test_reports_count_from_masks_without_distinct(spark, src):
    """Flags and order days are combined by user before their only exchange; masks and users need none."""
    plan = _plan(C.retention_geo(src, TESTDATA)[0])
    assert "distinct" not in plan and "partial_collect_set" in plan and "partial_bit_or" in plan
    below = plan[plan.index("collect_set"):]
    assert below.count("hashpartitioning(user_id#") >= 2
    # Above the two collected sides: one exchange for the cohorts' sums and one for the order of the report.
    above = plan[:plan.index("collect_set")]
    assert above.count("Exchange") <= 2


def _nodes(node):
    yield node
    kids = node.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def _unique_side(node) -> bool:
    """The side is an aggregate (one row per key) under projections/filters."""
    while node.nodeName() in ("Project", "Filter"):
        node = node.child()
    return node.nodeName() == "Aggregate"


def _restaurant_joins(df) -> list[tuple[str, bool]]:
    """Joins of ledger rows on the restaurant key, and whether each is free of pairing.

    A join on the restaurant key alone pairs every order with every ledger
    line of its restaurant.  It must also be keyed by the day or amount of an
    ask, only filter, or have a side with one row per key.
    """
    found = []
    for node in _nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() != "Join" or not node.condition().isDefined():
            continue
        cond = node.condition().get().toString()
        ledger = any(
            re.search(r"\b(commission_rate|restaurant_order_net|net|rate|near\d|any\d)#", side.output().toString())
            for side in (node.left(), node.right())
        )
        if "restaurant_id" not in cond or not ledger:
            continue
        keyed = re.search(r"\b(k_)?(day|subtotal)#\d+L? (=|<=>) (k_)?(day|subtotal)#", cond) is not None
        filters = node.joinType().toString() in ("LeftSemi", "LeftAnti")
        found.append((cond, keyed or filters or _unique_side(node.left()) or _unique_side(node.right())))
    return found


def test_commission_plan_has_no_order_ledger_pairing(spark):
    with recorded() as cut:
        df = E.queries()["commission_combined"](spark, SF_SMALL)
    joins = [j for frame in [*cut, df] for j in _restaurant_joins(frame)]
    # the listed restaurants cut the ledger; orders meet their answers of the week and of any date
    assert len(cut) == 1 and len(joins) >= 3
    bad = [cond for cond, fine in joins if not fine]
    assert not bad, bad


def test_a_pairing_join_is_found(spark, src):
    orders = src.orders.select("restaurant_id", "id")
    assert [fine for _, fine in _restaurant_joins(orders.join(src.ledger, "restaurant_id"))] == [False]
