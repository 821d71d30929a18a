"""The one-scan alcohol totals against B15, B16 and B17 one after the other, and their plan."""

from __future__ import annotations

from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from careops.operators import alcohol as A
from careops.plans import compositions as C
from careops.plans.params import TESTDATA
from careops.sources.testdata import testdata_sources
from tests.conftest import SF_SMALL, rows

ITEMS = ("mi_menu_category_name string, mi_name string, mi_description string, mi_alcohol boolean, order_id long, "
         "oi_quantity int, oi_unit_price decimal(10,2)")

item = st.tuples(
    st.sampled_from(["Wine", "Beer", "Sides", "Garlic  ", "Kids meal", None]), st.sampled_from(["a", "b"]), st.just("d"),
    st.sampled_from([True, False, None]), st.one_of(st.none(), st.integers(1, 4)), st.sampled_from([None, 0, 1, 2]),
    st.sampled_from([None, D("1.25"), D("3.00")]),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(item, max_size=14))
def test_equals_the_operators_one_after_the_other(spark, lines):
    items = spark.createDataFrame(lines, ITEMS)
    listed = spark.createDataFrame([(1,), (2,), (2,), (3,)], "orders long")
    flagged_out, out, prefix = ["Garlic  "], ["Sides"], "Kids"
    tp = A.alcohol_true_positives(items, listed, flagged_out)
    want = A.alcohol_order_totals(tp, A.alcohol_false_negatives(items, listed, tp, out, prefix))
    got = A.alcohol_totals_one_scan(items, listed, flagged_out, out, prefix)
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_items_are_scanned_once(spark):
    src = testdata_sources(spark, SF_SMALL)
    src._built["items"] = spark.read.parquet(_stored(src.items, spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = C.alcohol_totals(src, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "oi_unit_price" in x]
    assert len(scans) == 1 and "ReusedExchange" in plan


def _stored(df, spark) -> str:
    import uuid

    path = f"{spark.conf.get('spark.checkpoint.dir')}/items-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
