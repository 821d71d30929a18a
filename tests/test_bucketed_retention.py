"""Retention on relations that are stored in buckets of the user: the same rows, and nothing moves below the masks."""

from __future__ import annotations

import uuid

import pytest

from careops import sinks
from careops.operators import retention as R
from careops.plans import compositions as C
from careops.plans.params import TESTDATA
from careops.sources.testdata import testdata_sources
from tests.conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def stored(spark):
    src = testdata_sources(spark, SF_SMALL)
    mark = uuid.uuid4().hex[:8]
    flags = C.flags(src, TESTDATA, C.week_cohorts(src, TESTDATA), two_flags=True, keep_duplicates=False)
    names = [f"orders_by_user_{mark}", f"flags_by_user_{mark}"]
    yield flags, src.orders, [sinks.store_by_user(df, n, 4) for df, n in zip((src.orders, flags), names)]
    for n in names:
        spark.sql(f"drop table {n}")


def test_masks_move_nothing(spark, stored):
    flags, orders, (orders_b, flags_b) = stored
    window = TESTDATA.week_window
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        masks = R.return_weeks(flags_b, orders_b, cohort_window=window)
        plan = masks._jdf.queryExecution().executedPlan().toString()
        report = R.retained_users(masks, "cs_contact", 0)
        above = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # The report adds the cohorts' sums and its order, nothing below them.
    assert above.count("Exchange") == 2
    assert rows(masks) == rows(R.return_weeks(flags, orders, cohort_window=window)) != []
