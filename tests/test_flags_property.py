"""B05 contact flags against a brute force (duplicate claims, repeated contacts)."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from careops.operators.retention import cohort_contact_flags

ids = st.integers(0, 5)


def brute(cohorts, contacts, claims, keep_duplicates):
    out = Counter()
    contacted = set(c for c in contacts if c is not None)
    per_order = Counter(c for c in claims if c is not None)
    for user, oid in cohorts:
        cs = 1 if oid in contacted else 0
        ss = 1 if per_order[oid] else 0
        copies = max(per_order[oid], 1) if keep_duplicates else 1
        out[(user, oid, cs, ss)] += copies
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(ids, unique=True, min_size=1, max_size=5),
    st.lists(st.one_of(st.none(), ids), max_size=8),
    st.lists(st.one_of(st.none(), ids), max_size=12),
    st.booleans(),
)
def test_flags_match_brute_force(spark, order_ids, contacts, claims, keep_duplicates):
    cohorts = [(100 + oid, oid) for oid in order_ids]
    t = dt.datetime(2024, 1, 2, 10)
    c_df = spark.createDataFrame([(u, o, t, 1) for u, o in cohorts],
                                 "user_id long, id long, first_delivery_date timestamp_ntz, cohort int")
    ct_df = spark.createDataFrame([(c,) for c in contacts], "order_id long")
    cl_df = spark.createDataFrame([(c,) for c in claims], "order_id long")
    got = Counter(
        (r.user_id, r.first_order_id, r.cs_contact, r.self_serve)
        for r in cohort_contact_flags(c_df, ct_df, cl_df, keep_duplicates=keep_duplicates).collect()
    )
    assert got == brute(cohorts, contacts, claims, keep_duplicates)
