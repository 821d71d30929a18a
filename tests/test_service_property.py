"""B13 answer-time buckets against a brute force on random flag sets."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from careops.operators.service import ANSWER_THRESHOLDS, answer_time_buckets

FLAGS = [f"was_ans_in_{t}s" for t in ANSWER_THRESHOLDS]
SCHEMA = ("call_guid long, origin_country_name string, csat_good boolean, csat_bad boolean, "
          "was_answered boolean, start_timestamp timestamp_ntz, " + ", ".join(f"{f} boolean" for f in FLAGS))

flag = st.one_of(st.none(), st.booleans())
call = st.tuples(
    st.integers(0, 6),                                   # call id (repeats allowed)
    st.sampled_from(["X", "UK", None]),
    st.one_of(st.none(), st.booleans()),                 # csat_good
    st.booleans(),                                       # csat_bad
    st.one_of(st.none(), st.booleans()),                 # was_answered
    st.sampled_from([0, 5, 40]),                         # day offset (40: outside the window)
    st.tuples(*[flag] * len(FLAGS)),
)


def brute(calls):
    rows = set()
    for guid, country, good, bad, answered, day, flags in calls:
        if country is None or country == "UK" or good is not True or answered is not True or day > 30:
            continue
        buckets = []
        for first_true in range(len(FLAGS) + 1):
            ok = all((f is True) if i >= first_true else (f is False) for i, f in enumerate(flags))
            buckets.append(1 if ok else 0)
        rows.add((guid, tuple(buckets), 1, 1 if bad else 0))
    sums = [sum(r[1][k] for r in rows) for k in range(len(FLAGS) + 1)]
    return len(rows), sums


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(call, min_size=0, max_size=12))
def test_buckets_match_brute_force(spark, calls):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(g, c, good, bad, ans, start + dt.timedelta(days=d), *f) for g, c, good, bad, ans, d, f in calls], SCHEMA
    )
    r = answer_time_buckets(df, "2024-01-01", "2024-01-31", ["UK"]).collect()[0].asDict()
    count, sums = brute(calls)
    # bucket k = first True flag at position k (k = len: all False -> over_300)
    names = [f"answered_{t}" for t in ANSWER_THRESHOLDS] + ["answered_over_300"]
    assert r["call_count"] == count
    assert [r[n] or 0 for n in names] == sums
