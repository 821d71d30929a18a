"""Steps whose memory follows the rows of a task: dealt by row count, whatever adaptive execution would join."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from careops.functions import dealing
from careops.operators import alcohol as A
from careops.operators import commission as M
from careops.operators import payments as P
from tests.conftest import rows
from tests.test_alcohol_one_scan import ITEMS
from tests.test_commission_plan import hot_tables
from tests.test_commission_property import expected


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _dealt(plan: str, *keys: str) -> list[int]:
    """Partition counts of the steps dealt by ``keys``."""
    import re

    by = ", ".join(rf"{k}#\d+L?" for k in keys)
    return [int(n) for n in re.findall(rf"RepartitionByExpression \[{by}\], (\d+)", plan)]


def test_partitions_follow_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert dealing.tasks_for(spark.range(1), 0) == cores
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 100)
    assert dealing.tasks_for(spark.range(1), 1000 * cores) == 10 * cores
    assert dealing.tasks_for(spark.range(1), 1000 * cores + 1) == 10 * cores + 1
    assert dealing.dealt(spark.range(100), 7, "id").rdd.getNumPartitions() == 7


@pytest.mark.parametrize("rows_per_task", [40, 500_000])
def test_the_commission_sweeps_are_dealt_by_rows(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", rows_per_task)
    orders, ledger, oa, led = hot_tables(spark, n=900, seed=5)
    match = M.commission_match(oa, led)
    plan = _plan(match)
    need = lambda n: max(spark.sparkContext.defaultParallelism, -(-n // rows_per_task))
    assert _dealt(plan, "restaurant_id", "day", "subtotal") == [need(150)]
    assert _dealt(plan, "restaurant_id", "subtotal") == [need(150)]
    assert set(_dealt(plan, "restaurant_id", "block", "place", "net")) == {need(900)}
    assert set(_dealt(plan, "restaurant_id", "block")) == {need(900 + 4 * 150), need(900 + 150)}
    got = {r.orders: (r.commission_rank, r.commission_rate) for r in match.collect()}
    assert got == expected(orders, ledger)


def test_asks_are_made_distinct_once(spark):
    _, _, oa, _ = hot_tables(spark, n=900, seed=6)
    given = oa.select("orders", "restaurant_id", F.to_date("created_at").alias("day"), "subtotal")
    asks = M.order_asks(given, M.BLOCK_DAYS, M.WEEK_DAYS, 6)
    assert asks.count() == asks.distinct().count() == M.order_asks(
        given.unionAll(given), M.BLOCK_DAYS, M.WEEK_DAYS).count()
    none = M.ledger_points(M.usable_ledger(hot_tables(spark, n=10)[3]), M.BLOCK_DAYS).limit(0)
    assert "Aggregate [" not in _plan(M.answers(none, spark.createDataFrame(asks.collect(), asks.schema), M.BLOCK_DAYS, 6))


def test_alcohol_lines_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 20)
    lines = [(c, "a", "d", f, o, q, D("1.25")) for c, f in (("Wine", True), ("Wine", False), ("Sides", False), (None, True))
             for o in (1, 2, None) for q in (1, 2, 2, None)]
    items = spark.createDataFrame(lines * 5, ITEMS)
    listed = spark.createDataFrame([(1,), (2,), (2,)], "orders long")
    got = A.alcohol_totals_one_scan(items, listed, [], ["Sides"], None)
    assert set(_dealt(_plan(got), "order_id")) == {len(lines) * 5 // 20}
    tp = A.alcohol_true_positives(items, listed, [])
    assert rows(got) == rows(A.alcohol_order_totals(tp, A.alcohol_false_negatives(items, listed, tp, ["Sides"], None)))


def test_enriched_orders_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 10)
    listed = spark.createDataFrame([(i % 60,) for i in range(120)], "orders long")
    orders = spark.createDataFrame(
        [(i, i % 3, "CANCELLED", "10.00") for i in range(60)] * 2, "id long, restaurant_id long, status string, subtotal string"
    ).withColumn("created_at", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    adjusted = spark.createDataFrame([(i, D("1.00")) for i in range(0, 60, 2)], "orders long, adjustment_cost decimal(18,2)")
    alcohol = spark.createDataFrame([(i, D("2.00")) for i in range(0, 60, 3)], "order_id long, order_total decimal(18,2)")
    names = spark.createDataFrame([(i, "r", "c") for i in range(3)],
                                  "restaurant_id long, restaurant_name string, restaurant_company string")
    got = P.orders_with_alcohol(listed, adjusted, orders, alcohol, names)
    assert _dealt(_plan(got), "orders") == [12]
    assert sorted((r.orders, r.adjustment_flag, r.alcohol_cost) for r in got.collect()) == [
        (i, "N" if i % 2 else "Y", D("0.00") if i % 3 else D("2.00")) for i in range(60)]


def test_what_the_sweeps_found_is_combined_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 40)
    orders, ledger, oa, led = hot_tables(spark, n=900, seed=8)
    match = M.commission_match(oa, led)
    plan = _plan(match)
    assert _dealt(plan, "restaurant_id", "subtotal", "day") == [4 * 150 // 40]
    assert _dealt(plan, "orders") == [max(spark.sparkContext.defaultParallelism, -(-150 // 40))]
    got = {r.orders: (r.commission_rank, r.commission_rate) for r in match.collect()}
    assert got == expected(orders, ledger)


def test_a_long_list_does_not_sort_the_ledger(spark, monkeypatch):
    orders, ledger, oa, led = hot_tables(spark, n=900, seed=9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows_per_task, join in ((500_000, "SortMergeJoin"), (40, "ShuffledHashJoin")):
            monkeypatch.setattr(dealing, "ROWS_PER_TASK", rows_per_task)
            match = M.commission_match(oa, led)
            plan = match._jdf.queryExecution().sparkPlan().toString()
            semi = [x for x in plan.splitlines() if "LeftSemi" in x]
            assert semi and all(join in x for x in semi)
            assert {r.orders: (r.commission_rank, r.commission_rate) for r in match.collect()} == expected(orders, ledger)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_lines_of_orders_are_dealt_by_rows(spark, monkeypatch):
    from careops.sources.testdata import testdata_sources

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    orders = testdata_sources(spark, sf).orders
    want = rows(orders)
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 100)
    cut = testdata_sources(spark, sf).orders
    assert _dealt(_plan(cut), "l_orderkey") == [-(-n // 100)]
    assert rows(cut) == want
    # Where no one asks for the restaurant, nothing is read for it.
    assert "l_suppkey" not in _plan(cut.select("id", "user_id"))
