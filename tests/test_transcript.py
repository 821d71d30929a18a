"""Numbers against a brute force, and the exchanges that carry message text."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as E
from careops.operators import contacts
from tests.conftest import SF_SMALL, rows

LOG = ("chat_id long, event_timestamp timestamp_ntz, event_type string, is_visitor_event boolean, "
       "is_agent_event boolean, message_body string")
START = datetime(2024, 1, 1)


def _key(value):
    return (value is not None, value if value is not None else 0)


def expected(log, chats):
    listed = Counter(c for c in chats if c is not None)
    out = []
    for chat, copies in listed.items():
        mine = [r for r in log if r[0] == chat and r[2] == "chat.msg"]
        mine.sort(key=lambda r: (_key(r[1]), (r[5] is not None, r[5] or ""), _key(r[3]), _key(r[4])))
        every = [r for r in mine for _ in range(copies)]
        out += [(chat, r[5] if r[3] else None, r[5] if r[4] else None, i + 1) for i, r in enumerate(every)]
    return sorted(out, key=repr)


def messages(seed, n=900):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        chat = 1 if i % 3 == 0 else rnd.choice([None, *range(2, 40)])  # one chat holds a third of all rows
        time = None if rnd.random() < 0.05 else START + timedelta(minutes=rnd.randrange(30))
        body = None if rnd.random() < 0.05 else rnd.choice(["", "hi", "where is it", "é" * 40, f"m{i}"])
        flag = lambda: rnd.choice([True, False, None])
        out.append((chat, time, rnd.choice(["chat.msg"] * 5 + ["chat.system"]), flag(), flag(), body))
    return out + [out[0]] * 50 + [(1, datetime(1970, 1, 1), "chat.msg", True, False, "epoch")]


@pytest.mark.parametrize("limit", [100_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_equal_brute_force(spark, seed, limit):
    log = messages(seed)
    listed = [1, 2, 3, 3, 3, 5, 8, 8, None, 77] + list(range(10, 30))
    chats = spark.createDataFrame([(c,) for c in listed], "chat_id long")
    got = contacts.chat_transcript(spark.createDataFrame(log, LOG).repartition(5), chats, instant_messages=limit)
    assert rows(got) == expected(log, listed)


def test_empty_tables(spark):
    log, chats = spark.createDataFrame([], LOG), spark.createDataFrame([(1,)], "chat_id long")
    assert contacts.chat_transcript(log, chats).collect() == []
    some = spark.createDataFrame(messages(3), LOG)
    assert contacts.chat_transcript(some, chats.limit(0)).collect() == []


def test_text_moves_once(spark):
    """No broadcast here: the join by (chat, instant) is the one exchange that carries text, and the window needs none."""
    from careops.functions.materialize import recorded

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        with recorded() as frames:
            df = E.queries()["chat_transcript"](spark, SF_SMALL)
        plans = [f._jdf.queryExecution().executedPlan() for f in [df, *frames]]
        carrying = [n for p in plans for n in exchanges(p) if "message_body" in n.output().mkString(",")]
        assert len(carrying) == 1
        assert df.count() > 0
    finally:
        spark.conf.set(key, old)


def exchanges(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        yield from exchanges(node.initialPlan())
        return
    if node.nodeName() == "Exchange":
        yield node
    kids = node.children()
    for i in range(kids.size()):
        yield from exchanges(kids.apply(i))
