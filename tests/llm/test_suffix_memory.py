"""What the suffix operator's Python workers hold beside their batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from careops.llm import suffix_dedup as S
from careops.llm.common import byte_column, slices

LENGTH, GRAM = 400, 64


def _peak(run) -> tuple[object, float]:
    tracemalloc.start()
    try:
        got = run()
        return got, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_table_of_segments_takes_little_beside_its_sorted_rows():
    m, rng = 12_000, np.random.default_rng(7)
    group = np.sort(rng.integers(0, m // 3, m))
    rel, span = np.full(m, 100), np.zeros(m, np.int64)
    # Some segments of a group are alike, though their digests differ here.
    body = rng.integers(0, 256, (m, LENGTH), dtype=np.uint8)
    twin = np.flatnonzero((group[1:] == group[:-1]) & (rng.random(m - 1) < 0.2)) + 1
    for i in twin:
        body[i] = body[i - 1]
    matched, peak = _peak(lambda: S.suffix_matches(
        group, body.ravel(), np.arange(m) * LENGTH, rel, span, np.ones(m, np.int64), np.arange(m), LENGTH, GRAM, False))
    want = np.zeros(m, bool)
    want[twin] = want[twin - 1] = True
    assert (matched[:, 0] == want).all() and not matched[:, 1:].any()
    assert peak < 12 * m * LENGTH / 2**20


def test_segments_of_a_batch_are_scanned_in_small_slices():
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 123, 4000, dtype=np.uint8).tobytes() for _ in range(500)]
    data, offsets = byte_column(pa.array(texts))
    whole = S.segments(data, offsets, LENGTH, GRAM)

    def run():
        parts = []
        for i, j in slices(offsets, S.SLICE_BYTES):
            text, *rest = S.segments(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], LENGTH, GRAM)
            parts.append((text + i, *rest))
        return [np.concatenate(x) for x in zip(*parts)]

    S.Rolling._tables.clear()
    got, peak = _peak(run)
    assert all((a == b).all() for a, b in zip(got, whole))
    assert peak < 48


def test_removed_runs_are_read_from_arrow():
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    rows = pa.array([[{"s": 5, "e": 9}, {"s": 0, "e": 3}, {"s": 3, "e": 4}], [], None], kind)
    assert [S._removed(x, False, 10) for x in rows] == [[(0, 4), (5, 9)], [], []]
    assert [S._removed(x, True, 10) for x in rows] == [[(0, 10)]] * 3
    assert S._removed(rows[2], True, 0) == []
