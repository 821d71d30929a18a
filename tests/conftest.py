from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from careops.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.oracle_check import duck

    return duck(SF_SMALL)


def rows(df, order=None):
    """Collect a DataFrame as sorted tuples (columns in ``order`` if given)."""
    cols = order or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
