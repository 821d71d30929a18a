"""``nearest_points`` against a brute-force answer.

Data has one key holding a third of all rows, repeated query values, NULL
values and keys, and is run at several range-partition counts, with and
without a filter applied on top (a filter the optimizer may push into one
branch of the plan only).
"""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from careops.functions.nearest import nearest_points

PTS = StructType([
    StructField("k", LongType()), StructField("v", DecimalType(12, 2)), StructField("rate", StringType()),
])
QS = StructType([
    StructField("qid", LongType()), StructField("k", LongType()), StructField("s", DecimalType(12, 2)),
])


def _data(seed: int):
    rnd = random.Random(seed)
    keys = [0] * 300 + list(range(1, 31)) * 20  # key 0 holds a third
    points = {}
    for k in keys:
        v = Decimal(rnd.randrange(0, 5000)) / 100
        points[(k, v)] = min(points.get((k, v), "~"), f"r{rnd.randrange(100):02d}")
    pts = [(k, v, r) for (k, v), r in points.items()]
    pts.append((None, Decimal("1.00"), "rX"))
    pts.append((5, None, "rY"))
    qs = []
    for i in range(900):
        k = rnd.choice(keys + [99])
        s = Decimal(rnd.randrange(0, 5000)) / 100 if i % 7 else Decimal("25.00")
        qs.append((i, k, s))
    qs.append((900, None, Decimal("3.00")))
    qs.append((901, 3, None))
    return pts, qs


def _brute(pts, qs):
    out = {}
    for qid, k, s in qs:
        if k is None or s is None:
            out[qid] = (None, None)
            continue
        cand = [(v, r) for kk, v, r in pts if kk == k and v is not None]
        below = [c for c in cand if c[0] <= s]
        above = [c for c in cand if c[0] > s]
        out[qid] = (max(below) if below else None, min(above) if above else None)
    return out


@pytest.mark.parametrize("n", [None, 1, 3, 8])
@pytest.mark.parametrize("filtered", [False, True])
def test_nearest_matches_brute_force(spark, n, filtered):
    pts, qs = _data(seed=n or 0)
    expect = _brute(pts, qs)
    res = nearest_points(
        spark.createDataFrame(pts, PTS), spark.createDataFrame(qs, QS), ["k"],
        point_value="v", point_payload="rate", query_id="qid", query_value="s", num_partitions=n,
    )
    if filtered:
        res = res.filter((F.col("qid") % 2 == 0) & F.col("prev").isNotNull())
        expect = {q: e for q, e in expect.items() if q % 2 == 0 and e[0] is not None}
    got = {
        r.qid: (
            (r.prev.value, r.prev.payload) if r.prev else None,
            (r.next.value, r.next.payload) if r.next else None,
        )
        for r in res.collect()
    }
    assert got == expect


@pytest.mark.parametrize("n", [None, 1, 4, 8])
def test_row_number_within_matches_window(spark, n):
    from pyspark.sql.window import Window

    from careops.functions.ordering import row_number_within

    rnd = random.Random(n or 0)
    data = [(0 if i % 3 == 0 else rnd.randrange(1, 40), rnd.randrange(0, 50), f"m{rnd.randrange(5)}") for i in range(1500)]
    data += [(None, 1, "x"), (7, None, "y")]
    df = spark.createDataFrame(data, "g long, t long, m string")
    got = row_number_within(df, ["g"], ["t", "m"], out="rn", num_partitions=n)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "m")))
    key = lambda r: (repr(r.g), repr(r.t), r.m, r.rn)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_hot_key_is_split_across_ranges(spark):
    from careops.functions.ranges import range_pieces

    rnd = random.Random(5)
    data = [(0 if i % 3 == 0 else rnd.randrange(1, 200), rnd.random()) for i in range(30_000)]
    df = spark.createDataFrame(data, "k long, x double")
    pieces = range_pieces(df, ["k", "x"], 16)
    per_pid = {r._pid: r.n for r in pieces.filter("k = 0").groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    hot = sum(per_pid.values())
    assert hot == 10_000
    assert len(per_pid) >= 4 and max(per_pid.values()) < 0.5 * hot


def test_row_number_within_many_identical_rows(spark):
    from pyspark.sql.window import Window

    from careops.functions.ordering import row_number_within

    data = [(1, 5, "same")] * 5000 + [(1, 3, "before"), (1, 9, "after"), (2, 1, "other")]
    df = spark.createDataFrame(data, "g long, t long, m string")
    got = row_number_within(df, ["g"], ["t"], out="rn", num_partitions=4)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "m")))
    key = lambda r: (r.g, r.t, r.m, r.rn)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
