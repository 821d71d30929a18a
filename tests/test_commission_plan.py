"""The commission sweep at scale: bounded groups under a hot restaurant, one ledger scan, the Bloom filter in front of it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from careops.functions.materialize import recorded
from careops.operators import commission as M
from tests.test_commission_property import BASE, LEDGER, OA, RATES, expected


def hot_tables(spark, n=6000, seed=3):
    """A restaurant with most lines and orders: few different amounts, days and subtotals, very many rows."""
    import random

    rng = random.Random(seed)
    ledger = [(1 if rng.random() < 0.7 else rng.randint(2, 30), rng.choice([None, *range(-12, 13)]),
               rng.choice([None, D("9.50"), D("10.00"), D("11.25")]), rng.choice(RATES)) for _ in range(n)]
    orders = [(1 if rng.random() < 0.7 else rng.randint(2, 40), rng.randint(-20, 20),
               rng.choice([None, D("0.00"), D("10.00"), D("10.60")])) for _ in range(n // 6)]
    oa = spark.createDataFrame(
        [(i, BASE + dt.timedelta(days=off, hours=5), rid, sub) for i, (rid, off, sub) in enumerate(orders)], OA)
    led = spark.createDataFrame(
        [(r, None if day is None else BASE + dt.timedelta(days=day, hours=3), net, rate) for (r, day, net, rate) in ledger],
        LEDGER)
    return orders, ledger, oa, led


def test_hot_restaurant_matches_brute_force_in_bounded_groups(spark):
    orders, ledger, oa, led = hot_tables(spark)
    got = {r.orders: (r.commission_rank, r.commission_rate) for r in M.commission_match(oa, led).collect()}
    assert got == expected(orders, ledger)
    given = oa.select("orders", "restaurant_id", F.to_date("created_at").alias("day"), "subtotal")
    points = M.ledger_points(M.usable_ledger(led), M.BLOCK_DAYS)
    asks = M.order_asks(given, M.BLOCK_DAYS, M.WEEK_DAYS)
    group = ["restaurant_id", "block"]
    largest = points.select(*group).unionAll(asks.select(*group)).groupBy(*group).count().agg(F.max("count")).first()[0]
    # 4 amounts on each place of the block, and 4 subtotals on each of the days that reach it
    assert largest <= 4 * M.BLOCK_DAYS + 4 * (M.BLOCK_DAYS + 2 * M.WEEK_DAYS)


@pytest.mark.parametrize("days", [1, 3, 15, 40])
def test_any_block_length_gives_the_same_match(spark, days, monkeypatch):
    orders, ledger, oa, led = hot_tables(spark, n=900, seed=days)
    monkeypatch.setattr(M, "BLOCK_DAYS", days)
    got = {r.orders: (r.commission_rank, r.commission_rate) for r in M.commission_match(oa, led).collect()}
    assert got == expected(orders, ledger)


def test_each_tier_alone_is_its_part_of_the_whole(spark):
    orders, ledger, oa, led = hot_tables(spark, n=900, seed=9)
    want = expected(orders, ledger)
    for tier in (1, 2, 3, 4):
        got = {r.orders: (r.commission_rank, r.commission_rate) for r in M.commission_match(oa, led, (tier,)).collect()}
        assert got == {k: v for k, v in want.items() if v[0] == str(tier)}


def test_a_long_list_puts_a_bloom_filter_before_the_ledgers_shuffle(spark, tmp_path):
    _, _, oa, led = hot_tables(spark, n=600)
    for name, df in (("orders", oa), ("ledger", led)):
        df.write.parquet(f"{tmp_path}/{name}")
    oa, led = spark.read.parquet(f"{tmp_path}/orders"), spark.read.parquet(f"{tmp_path}/ledger")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with recorded() as cut:
            plan = M.commission_match(oa, led)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(cut) == 1
    assert "might_contain" in plan and "bloom_filter_agg" in plan
    # The filter stands over the ledger's scan, below the aggregate that shuffles the points.
    line = next(x for x in plan.splitlines() if "might_contain" in x)
    assert "Filter" in line and plan.index("Aggregate") < plan.index("might_contain")
