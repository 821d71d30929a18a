"""Hand-made rows pinning each semantic rule (FIXTURES.md §3, M1–M18)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

from careops.functions.commission import fixed_com, perc_com
from careops.functions.predicates import exclude_dates, ts_between
from careops.operators import alcohol, commission, contacts, payments, retention, service

TS = TimestampNTZType()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def schema(*fields):
    return StructType([StructField(n, t) for n, t in fields])


# M1 / M2 ---------------------------------------------------------------------
def test_m1_window_end_is_midnight(spark):
    df = spark.createDataFrame([(ts("2024-01-31 00:00:00"),), (ts("2024-01-31 10:00:00"),)], schema(("t", TS)))
    kept = df.filter(ts_between("t", "2024-01-01", "2024-01-31")).collect()
    assert [r.t for r in kept] == [ts("2024-01-31 00:00:00")]


def test_m2_excluded_date_instant_vs_day(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-16 00:00:00"),), (ts("2024-01-16 09:00:00"),), (ts("2024-01-17 00:00:00"),)],
        schema(("t", TS)),
    )
    inst = {r.t for r in df.filter(exclude_dates("t", ["2024-01-16"], "instant")).collect()}
    day = {r.t for r in df.filter(exclude_dates("t", ["2024-01-16"], "day")).collect()}
    assert inst == {ts("2024-01-16 09:00:00"), ts("2024-01-17 00:00:00")}
    assert day == {ts("2024-01-17 00:00:00")}


# M3 / M4 / M5 ----------------------------------------------------------------
ORDERS = schema(("user_id", LongType()), ("delivered_at", TS))
FLAGS = schema(
    ("user_id", LongType()), ("first_order_id", LongType()), ("first_order_date", DateType()),
    ("cohort", IntegerType()), ("cs_contact", IntegerType()), ("self_serve", IntegerType()),
)


def test_m3_week_round(spark):
    d0 = dt.date(2024, 1, 1)
    flags = spark.createDataFrame([(1, 10, d0, 1, 0, 0)], FLAGS)
    later = [dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=g) for g in (0, 1, 7, 8, 84, 85)]
    orders = spark.createDataFrame([(1, t) for t in later], ORDERS)
    act = retention.retention_activity(flags, orders)
    assert sorted(r.week_round for r in act.collect()) == [1, 2, 12]  # 1 and 7 share week 1


def test_m4_duplicate_self_serve_claims(spark):
    cohorts = spark.createDataFrame(
        [(1, 10, ts("2024-01-02 10:00:00"), 1)],
        schema(("user_id", LongType()), ("id", LongType()), ("first_delivery_date", TS), ("cohort", IntegerType())),
    )
    contacts_df = spark.createDataFrame([], schema(("order_id", LongType())))
    claims = spark.createDataFrame([(10,), (10,)], schema(("order_id", LongType())))
    flags = retention.cohort_contact_flags(cohorts, contacts_df, claims)
    assert flags.count() == 2
    orders = spark.createDataFrame([(1, ts("2024-01-05 10:00:00"))], ORDERS)
    assert retention.retention_activity(flags, orders).count() == 1


def test_m4_replication_splits_large_counts(spark):
    from careops.functions.rows import replicate_rows

    df = spark.createDataFrame([(1, 10_000), (2, 3), (3, 0), (4, None)], "k long, n long")
    out = replicate_rows(df, "n", chunk=64)
    counts = {r.k: r.c for r in out.groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert counts == {1: 10_000, 2: 3}


def test_m5_exclusive_drops_double_flagged(spark):
    d0 = dt.date(2024, 1, 1)
    flags = spark.createDataFrame([(1, 10, d0, 1, 1, 1), (2, 11, d0, 1, 1, 0)], FLAGS)
    orders = spark.createDataFrame([(1, ts("2024-01-03 00:00:00")), (2, ts("2024-01-03 00:00:00"))], ORDERS)
    act = retention.retention_activity(flags, orders, exclusive=True)
    assert [r.user_id for r in act.collect()] == [2]


# M6 --------------------------------------------------------------------------
def test_m6_null_not_in_drops_row(spark):
    from careops.functions.predicates import not_in

    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert sorted(r.c for r in df.filter(not_in("c", ["b"])).collect()) == ["a"]


# M7 --------------------------------------------------------------------------
CLAIMS = schema(
    ("order_id", LongType()), ("is_self_serve_claim", BooleanType()), ("claim_time", TS),
    ("claim_reason", StringType()), ("claim_amount_gbp", DecimalType(10, 2)), ("order_total_gbp", DecimalType(12, 2)),
)


def test_m7_null_order_claim_summed_not_counted(spark):
    t = ts("2024-01-20 10:00:00")
    claims = spark.createDataFrame(
        [
            (1, False, t, "late live order", D("15.00"), D("100.00")),
            (1, False, t, "late order request credit", D("15.00"), D("100.00")),
            (None, False, t, "late live order", D("15.00"), None),
            (2, False, ts("2023-01-01 00:00:00"), "late live order", D("15.00"), D("50.00")),
            (3, False, t, "missing item", D("15.00"), D("50.00")),
        ],
        CLAIMS,
    )
    r = service.claim_cost_summary(claims, "2024-01-31", 21).collect()[0]
    assert (r.order_total, r.claim_amount_gbp_total, r.order_total_gbp_total) == (1, D("45.00"), D("200.00"))


# M8 --------------------------------------------------------------------------
def test_m8_answer_buckets(spark):
    flags = [f"was_ans_in_{t}s" for t in (15, 30, 45, 60, 90, 120, 300)]
    cols = [("call_guid", LongType()), ("origin_country_name", StringType()), ("csat_good", BooleanType()),
            ("csat_bad", BooleanType()), ("was_answered", BooleanType()), ("start_timestamp", TS)]
    cols += [(f, BooleanType()) for f in flags]
    t = ts("2024-01-05 00:00:00")
    base = [1, "X", True, False, True, t]
    data = [
        base + [False] * 7,  # all False -> over_300
        [2] + base[1:] + [True, False, True, True, True, True, True],  # non-monotone -> none
        [3] + base[1:] + [None, True, True, True, True, True, True],  # NULL -> none
        [4] + base[1:] + [False, False, True, True, True, True, True],  # -> answered_45
    ]
    df = spark.createDataFrame([tuple(d) for d in data], schema(*cols))
    r = service.answer_time_buckets(df, "2024-01-01", "2024-01-31").collect()[0].asDict()
    assert r["call_count"] == 4 and r["answered_over_300"] == 1 and r["answered_45"] == 1
    assert sum(v for k, v in r.items() if k.startswith("answered")) == 2


# M9 / M10 --------------------------------------------------------------------
LOG = schema(
    ("chat_id", LongType()), ("event_timestamp", TS), ("event_type", StringType()),
    ("is_visitor_event", BooleanType()), ("is_agent_event", BooleanType()), ("message_body", StringType()),
)


def test_m9_m10_transcript_and_fan_out(spark):
    log = spark.createDataFrame(
        [
            (1, ts("2024-01-01 00:00:00"), "chat.msg", True, False, "only"),
            (2, ts("2024-01-01 00:00:00"), "chat.system", False, False, "sys"),
            (2, ts("2024-01-01 00:01:00"), "chat.msg", True, False, "hi"),
            (2, ts("2024-01-01 00:02:00"), "chat.msg", False, True, "hello"),
            (2, ts("2024-01-01 00:03:00"), "chat.msg", True, False, "bye"),
        ],
        LOG,
    )
    chats = spark.createDataFrame([(1, "a"), (2, "b")], "chat_id long, lob string")
    tr = contacts.chat_transcript(log, chats)
    got = sorted((r.chat_id, r.chat_cum, r.customer_chat, r.agent_chat) for r in tr.collect())
    assert got == [(1, 1, "only", None), (2, 1, "hi", None), (2, 2, None, "hello"), (2, 3, "bye", None)]
    rows_mode = contacts.multi_message_chats(chats, tr, "rows")
    assert sorted(r.chat_id for r in rows_mode.collect()) == [2, 2]
    assert [r.chat_id for r in contacts.multi_message_chats(chats, tr, "distinct").collect()] == [2]


# Commission tiers -----------------------------------------------------
OA = schema(
    ("orders", LongType()), ("created_at", TS), ("restaurant_id", LongType()), ("subtotal", DecimalType(10, 2)),
)
LEDGER = schema(
    ("restaurant_id", LongType()), ("created_at", TS), ("restaurant_order_net", DecimalType(12, 2)),
    ("commission_rate", StringType()),
)


def _tiers(spark, orders, ledger):
    out = commission.commission_combined(spark.createDataFrame(orders, OA), spark.createDataFrame(ledger, LEDGER))
    return {r.orders: (r.commission_rank, r.commission_rate) for r in out.collect()}


def test_m11_null_net_loses_to_amount(spark):
    day = ts("2024-01-10 00:00:00")
    got = _tiers(spark, [(1, day, 7, D("10.00"))],
                 [(7, day, None, "10.00% + 0.10"), (7, day, D("5.00"), "30.00% + 0.30")])
    assert got == {1: ("1", "30.00% + 0.30")}
    # only NULL amounts: the smallest rate among them
    got = _tiers(spark, [(1, day, 7, D("10.00"))],
                 [(7, day, None, "20.00% + 0.10"), (7, day, None, "15.00% + 0.10")])
    assert got == {1: ("1", "15.00% + 0.10")}


def test_m12_tie_on_diff_takes_smallest_rate(spark):
    day = ts("2024-01-10 00:00:00")
    got = _tiers(spark, [(1, day, 7, D("10.00"))],
                 [(7, day, D("11.00"), "25.00% + 0.50"), (7, day, D("9.00"), "12.00% + 0.50"),
                  (7, day, D("20.00"), "01.00% + 0.10")])
    assert got == {1: ("1", "12.00% + 0.50")}


def test_m13_tier_bounds_and_default(spark):
    day = ts("2024-01-10 00:00:00")
    plus7, plus8 = ts("2024-01-17 00:00:00"), ts("2024-01-18 00:00:00")
    got = _tiers(
        spark,
        [(1, day, 7, D("10.00")), (2, day, 8, D("10.00")), (3, day, 9, D("10.00"))],
        [(7, plus7, D("10.00"), "20.00% + 0.20"), (8, plus8, D("10.00"), "21.00% + 0.20"),
         (9, day, D("10.00"), "Free Trial"), (9, day, D("10.00"), "0")],
    )
    assert got == {1: ("2", "20.00% + 0.20"), 2: ("3", "21.00% + 0.20"), 3: ("4", "0")}


# M14 / M15 -------------------------------------------------------------------
def test_m14_commission_and_payable_branches(spark):
    cases = [(0, 0), (0, 5), (5, 5), (20, 0), (20, 5), (5, 20)]
    expect_c = [D("0.50"), D("0.00"), D("0.00"), D("5.50"), D("4.25"), D("-3.25")]
    expect_p = [D("0.00"), D("0.00"), D("0.00"), D("14.50"), D("10.75"), D("-11.75")]
    oa = spark.createDataFrame(
        [(i, ts("2024-01-01 00:00:00"), None, "N", 1, "r", "c", D(s), D(a)) for i, (s, a) in enumerate(cases)],
        schema(("orders", LongType()), ("created_at", TS), ("adjustment_cost", DecimalType(18, 2)),
               ("adjustment_flag", StringType()), ("restaurant_id", LongType()), ("restaurant_name", StringType()),
               ("restaurant_company", StringType()), ("subtotal", DecimalType(10, 2)),
               ("alcohol_cost", DecimalType(18, 2))),
    )
    comb = spark.createDataFrame(
        [(i, "25.00% + 0.50", D("0.2500"), D("0.50"), "1") for i in range(len(cases))],
        schema(("orders", LongType()), ("commission_rate", StringType()), ("perc_com", DecimalType(10, 4)),
               ("fixed_com", DecimalType(10, 2)), ("commission_rank", StringType())),
    )
    got = {r.orders: (r.commission_calc, r.pay_adj_total) for r in payments.payment_adjustment(comb, oa).collect()}
    assert [got[i] for i in range(len(cases))] == list(zip(expect_c, expect_p))


def test_m15_rate_strings(spark):
    df = spark.createDataFrame([("25.00% + 0.50",), ("25.00%",), ("",)], "r string")
    got = [(x.p, x.f) for x in df.select(perc_com(F.col("r")).alias("p"), fixed_com(F.col("r")).alias("f")).collect()]
    assert got == [(D("0.2500"), D("0.50")), (D("0.2500"), D("5.00")), (None, None)]


# M16–M18 ---------------------------------------------------------------------
ITEMS = schema(
    ("order_id", LongType()), ("mi_menu_category_name", StringType()), ("mi_name", StringType()),
    ("mi_description", StringType()), ("mi_alcohol", BooleanType()), ("oi_quantity", DecimalType(6, 0)),
    ("oi_unit_price", DecimalType(10, 2)),
)


def test_m16_m17_literal_spaces_and_repeated_lines(spark):
    items = spark.createDataFrame(
        [
            (1, "Garlic", "beer", "d", True, D("1"), D("4.00")),
            (1, "Garlic", "beer", "d", True, D("1"), D("4.00")),  # repeated line
            (1, "Garlic  ", "wine", "d", True, D("1"), D("9.00")),  # excluded (exact spaces)
        ],
        ITEMS,
    )
    olist = spark.createDataFrame([(1,)], "orders long")
    tp = alcohol.alcohol_true_positives(items, olist, ["Garlic  "])
    assert tp.count() == 1
    fn = alcohol.alcohol_false_negatives(items, olist, tp, [])
    totals = alcohol.alcohol_order_totals(tp, fn).collect()
    assert [(r.order_id, r.order_total) for r in totals] == [(1, D("4.00"))]


def test_m18_null_adjustment_flag_n_and_duplicate_list(spark):
    adj = spark.createDataFrame([(1, None), (2, D("3.00")), (2, D("2.00"))], "order_id long, adjustment_cost decimal(12,2)")
    olist = spark.createDataFrame([(1,), (2,), (2,)], "orders long")
    got = {r.orders: r.adjustment_cost for r in payments.order_adjustments(adj, olist).collect()}
    assert got == {1: None, 2: D("10.00")}  # listed twice: counted twice
    orders = spark.createDataFrame(
        [(1, ts("2024-01-01 00:00:00"), 5, "10.00", "CANCELLED"), (2, ts("2024-01-01 00:00:00"), 5, "20.00", "DELIVERED")],
        "id long, created_at timestamp_ntz, restaurant_id long, subtotal string, status string",
    )
    rest = spark.createDataFrame([(5, "R", "C")], "restaurant_id long, restaurant_name string, restaurant_company string")
    alc = spark.createDataFrame([], "order_id long, order_total decimal(18,2)")
    oa = payments.orders_with_alcohol(olist, payments.order_adjustments(adj, olist), orders, alc, rest).collect()
    assert [(r.orders, r.adjustment_flag, r.alcohol_cost, r.subtotal) for r in oa] == [(1, "N", D("0.00"), D("10.00"))]


def test_m2_call_extract_day_mode(spark):
    from careops.plans.params import TESTDATA as P
    from careops.sources.testdata import testdata_sources

    calls = testdata_sources(spark, "/root/testdata/sf0.001").calls
    inst = contacts.call_extract(calls, *P.extract_window, P.extract_excluded_dates, P.lob, exclude="instant")
    day = contacts.call_extract(calls, *P.extract_window, P.extract_excluded_dates, P.lob, exclude="day")
    on_day = inst.filter(F.to_date("local_start_timestamp") == F.lit("2024-01-16").cast("date")).count()
    assert on_day > 0 and day.count() == inst.count() - on_day
