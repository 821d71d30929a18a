"""Whitening against numpy on the distinct integer vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, i int, x string, w double, component string, deviation int"


def check(rows, got, most, d):
    good = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = (n * np.array(fit, float) - np.array(sums)) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-values)[:most] if values[k] > 1e-9 * values.max()]
    every = (n * np.array(x, float) - np.array(sums)) / n
    white = every @ vectors[:, order] / np.sqrt(values[order])
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[order[r.component - 1]] / np.trace(cov), rel=1e-9)
    assert len(got) == len(good) * len(order)
    signs = {}
    for (name, _), v, w in zip(good, x, white):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        by = {}
        for r in seen[name, deviation]:
            by.setdefault(r.component, []).append(r.whitened)
        for k in range(len(order)):
            assert any(abs(abs(y) - abs(w[k])) < 1e-8 for y in by[k + 1])
            y = min(by[k + 1], key=lambda y: abs(abs(y) - abs(w[k])))
            if abs(y) > 1e-3:
                signs.setdefault(k, set()).add(y * w[k] > 0)
    assert all(len(s) == 1 for s in signs.values())


def make_rows(n, d, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1 + j) + rng.gauss(0, 1) for j in range(d)], 1, "x", 0.5, "c", 7) for i in range(n)]


def test_whitening(spark):
    from careops.llm.whitening import whiten

    rows = make_rows(300, 20)
    rows += [(900 + k, rows[0][1], 1, "x", 0.5, "c", 7) for k in range(150)]  # a hot vector
    rows += [(5, rows[9][1], 1, "x", 0.5, "c", 7), (None, rows[3][1], None, None, None, None, None)]
    for bad in (None, [], [1.0] * 19 + [None], [1.0] * 19 + [float("nan")], [1.0] * 19 + [float("inf")], [1.0, 2.0]):
        rows.append((2000, bad, 1, "x", 0.5, "c", 7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whiten(df, most=16)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, got.collect(), 16, 20)


def test_blocks_smaller_than_the_table(spark, monkeypatch):
    from careops.llm import whitening

    monkeypatch.setattr(whitening, "LEAST_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCKS", 1000)
    rows = make_rows(120, 5, seed=2)
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), 16, 5)


def test_low_rank_single_and_empty(spark):
    from careops.llm.whitening import whiten

    rows = [(i, [float(i), 2.0 * i, 3.0], 1, "x", 0.5, "c", 7) for i in range(40)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got, 16, 3)
    assert {r.component for r in got} == {1}
    assert whiten(spark.createDataFrame(rows[:1] * 3, SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviations_beyond_a_long(spark):
    from careops.llm.whitening import whiten

    rows = [(i, [float(i % 2) * 3e7 + i, float(i)], 1, "x", 0.5, "c", 7) for i in range(60)]
    n, x = 60, [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()} and None in got.values()
