"""Results as the operators return them: decimals with their scale, reports row by row in their order."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql.types import DecimalType

from careops.plans import registry
from tests.conftest import SF_CHECK, SF_SMALL

MONEY = sorted({
    "claim_cost_summary", "alcohol_true_positives", "alcohol_false_negatives", "alcohol_order_totals", "order_adjustments",
    "orders_with_alcohol", "commission_same_day", "commission_fortnight", "commission_anytime", "commission_default",
    "commission_combined", "payment_adjustment",
})
REPORTS = sorted(n for n in registry.queries() if n in ("retained_users", "cohort_totals")
                 or n.startswith("retention_") and n.endswith(("_retained", "_totals")))


def scales(types):
    return {c: int(t.rstrip(")").split(",")[1]) for c, t in types if t.upper().startswith("DECIMAL")}


def test_queries_with_decimals_are_listed(spark):
    decimal = [n for n, q in registry.queries(exact=True).items() if not n.startswith(("commission", "payment"))
               and any(isinstance(f.dataType, DecimalType) for f in q(spark, SF_SMALL).schema.fields)]
    assert set(decimal) <= set(MONEY)


@pytest.mark.parametrize("name", MONEY)
def test_decimals_keep_type_scale_and_value(spark, duck_small, name):
    df = registry.queries(exact=True)[name](spark, SF_SMALL)
    sql = registry.oracle_sql(exact=True)[name]
    types = [(c, str(t)) for c, t, *_ in duck_small.execute(f"describe {sql}").fetchall()]
    assert scales(df.dtypes) == scales(types)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    at = [[c for c, _ in types].index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in duck_small.execute(sql).fetchall())
    assert got == want  # repr shows a decimal's digits, so another scale differs


def test_scale_shows_in_the_comparison():
    assert repr(Decimal("1.50")) != repr(Decimal("1.5")) and scales([("a", "decimal(10,2)")]) == {"a": 2}


@pytest.fixture(scope="module")
def duck_check():
    from tools.oracle_check import duck

    return duck(SF_CHECK)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_come_in_order(spark, duck_check, name):
    df = registry.queries()[name](spark, SF_CHECK)
    key = [c for c in ("cohort", "week_round") if c in df.columns]
    if not key:
        pytest.skip("a report without its cohort has no order")
    order = ", ".join(f"{c} nulls first" for c in key)
    want = duck_check.execute(
        f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]}) report order by {order}").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert got == want
    if len(want) > 1:
        assert got[::-1] != want
