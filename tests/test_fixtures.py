"""The DataFrame and SQL derivations of the test relations give the same rows,
and FIXTURES.md shows the SQL that is actually used."""

from __future__ import annotations

import os

import pytest

from careops.sources.testdata import testdata_sources
from careops.sources.testdata_sql import CTE, with_ctes
from tests.conftest import SF_SMALL
from tools.oracle_check import norm_rows

PAIRS = {
    "orders": "f_orders", "zones": "f_zones", "calls": "f_calls", "chats": "f_chats",
    "chat_event_log": "f_chatlog", "emails": "f_emails", "claims": "f_claims",
    "order_list": "f_order_list", "items": "f_items", "adjustments": "f_adjustments",
    "restaurants": "f_restaurants", "ledger": "f_ledger",
}


@pytest.mark.parametrize("relation", sorted(PAIRS))
def test_derivations_agree(spark, duck_small, relation):
    df = testdata_sources(spark, SF_SMALL)[relation]
    cur = duck_small.execute(with_ctes(f"select * from {PAIRS[relation]}", *CTE))
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    srows = [tuple(r) for r in df.collect()]
    drows = [tuple(r) for r in cur.fetchall()]
    assert norm_rows(df.columns, srows)[0] == norm_rows(dcols, drows)[0]


def test_fixtures_doc_shows_current_sql():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
    text = open(path).read()
    for name, sql in CTE.items():
        assert f"-- {name}\n{sql.strip()}" in text, name
