"""Every registered query agrees with its DuckDB oracle on the sf0.001 tables.

The comparison is strict: same row count, same column names and the same
multiset of rows with values compared by ``repr`` (decimal scale and integer
versus float differences count).
"""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from careops.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import norm_rows

NAMES = sorted(registry.queries())


def test_every_query_has_oracle_sql():
    assert set(registry.oracle_sql()) == set(NAMES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck_small.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = [tuple(r) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert norm_rows(df.columns, srows)[0] == norm_rows(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort", "retained_users", "week_round"]
    assert df.count() > 0


def test_no_decimal_columns_leave_the_registry(spark, duck_small):
    from pyspark.sql.types import DecimalType

    sql = E.oracle_sql()
    for name in NAMES:
        df = E.queries()[name](spark, SF_SMALL)
        assert not any(isinstance(f.dataType, DecimalType) for f in df.schema.fields), name
        types = [str(t) for _, t, *_ in duck_small.execute(f"describe {sql[name]}").fetchall()]
        assert not any(t.upper().startswith("DECIMAL") for t in types), name
