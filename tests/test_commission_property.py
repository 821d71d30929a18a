"""Commission tiers against a brute-force reading of the warehouse cascade.

Random small ledgers and order lists (NULL amounts and subtotals, tied
differences, day offsets around ±7, non-commission rate texts, NULL
restaurants) go through ``commission_match``; a plain-Python cascade gives
the expected tier and rate per order.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType, TimestampNTZType

from careops.functions.commission import NON_COMMISSION_RATES
from careops.operators.commission import commission_match

BASE = dt.datetime(2024, 3, 1)
RATES = ["10.00% + 0.10", "12.50% + 0.20", "25.00% + 0.50", "Free Trial", "0", "Redelivery", None]
NETS = [None, D("5.00"), D("9.00"), D("10.00"), D("11.00"), D("30.00")]

OA = StructType([
    StructField("orders", LongType()), StructField("created_at", TimestampNTZType()),
    StructField("restaurant_id", LongType()), StructField("subtotal", DecimalType(10, 2)),
])
LEDGER = StructType([
    StructField("restaurant_id", LongType()), StructField("created_at", TimestampNTZType()),
    StructField("restaurant_order_net", DecimalType(12, 2)), StructField("commission_rate", StringType()),
])

ledger_line = st.tuples(
    st.sampled_from([1, 2]),
    st.one_of(st.none(), st.integers(-9, 9)),
    st.sampled_from(NETS),
    st.sampled_from(RATES),
)
order = st.tuples(
    st.one_of(st.none(), st.sampled_from([1, 2, 3])),
    st.integers(-2, 2),
    st.sampled_from([None, D("0.00"), D("10.00"), D("20.00")]),
)


def expected(orders, ledger):
    out = {}
    for oid, (rid, off, sub) in enumerate(orders):
        lines = [
            (day, net, rate) for (r, day, net, rate) in ledger
            if r == rid and rate is not None and rate not in NON_COMMISSION_RATES
        ]
        tiers = [
            [ln for ln in lines if ln[0] is not None and ln[0] == off],
            [ln for ln in lines if ln[0] is not None and abs(ln[0] - off) <= 7],
            lines,
        ]
        for k, cands in enumerate(tiers, start=1):
            if cands:
                def key(ln):
                    diff = None if ln[1] is None or sub is None else abs(ln[1] - sub)
                    return (diff is None, diff or 0, ln[2])
                out[oid] = (str(k), min(cands, key=key)[2])
                break
        else:
            out[oid] = ("4", "0")
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ledger_line, min_size=0, max_size=10), st.lists(order, min_size=1, max_size=5))
def test_commission_matches_brute_force(spark, ledger, orders):
    oa = spark.createDataFrame(
        [(i, BASE + dt.timedelta(days=off, hours=5), rid, sub) for i, (rid, off, sub) in enumerate(orders)], OA
    )
    led = spark.createDataFrame(
        [(r, None if day is None else BASE + dt.timedelta(days=day, hours=3), net, rate) for (r, day, net, rate) in ledger],
        LEDGER,
    )
    got = {r.orders: (r.commission_rank, r.commission_rate) for r in commission_match(oa, led).collect()}
    assert got == expected(orders, ledger)
