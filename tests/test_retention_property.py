"""Retention activity against a brute force, with and without the date cut.

``cohort_window`` lets the orders scan skip dates that cannot match; the
result must not change, including for first orders on the window edges and
return orders on the last day of the horizon.
"""

from __future__ import annotations

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from careops.operators.retention import retention_activity

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
D0 = dt.date(2024, 1, 1)

user = st.tuples(
    st.sampled_from([0, 1, 15, 30]),            # first-order day offset within the window
    st.integers(0, 1), st.integers(0, 1),        # cs_contact, self_serve
    st.lists(st.integers(-3, 120), max_size=5),  # later order day offsets from the first order
)


def brute(users, exclusive):
    out = set()
    for uid, (d, cs, ss, later) in enumerate(users):
        if exclusive and cs + ss >= 2:
            continue
        for g in later:
            if 0 < g <= 84:
                out.add((uid, d + 1, cs, ss, math.ceil(g / 7)))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(user, min_size=1, max_size=6), st.booleans())
def test_activity_matches_brute_force(spark, users, exclusive):
    flags = spark.createDataFrame(
        [(uid, D0 + dt.timedelta(days=d), d + 1, cs, ss) for uid, (d, cs, ss, _) in enumerate(users)],
        "user_id long, first_order_date date, cohort int, cs_contact int, self_serve int",
    )
    orders = spark.createDataFrame(
        [(uid, dt.datetime(2024, 1, 1, 23, 30) + dt.timedelta(days=d + g))
         for uid, (d, _, _, later) in enumerate(users) for g in later] or [(0, dt.datetime(2000, 1, 1))],
        "user_id long, delivered_at timestamp_ntz",
    )
    want = brute(users, exclusive)
    for window in (None, (START, END)):
        act = retention_activity(flags, orders, 12, exclusive=exclusive, cohort_window=window)
        got = {(r.user_id, r.cohort, r.cs_contact, r.self_serve, r.week_round) for r in act.collect()}
        assert got == want, window
