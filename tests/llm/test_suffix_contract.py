"""op1's query on planted passages: what shares 400 bytes goes, what shares fewer stays, however many words it has."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

SIZE = 400


def words(rng, n, least, most):
    return " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(least, most))) for _ in range(n))


def planted(rng):
    """(doc_id, text) rows, and the bytes that each document shares with another one."""
    passages = [words(rng, 51, 2, 7) for _ in range(8)] + [words(rng, 51, 8, 11) for _ in range(8)]
    passages += [words(rng, 60, 6, 8).replace("a", "é") for _ in range(4)]
    passages += [words(rng, 70, 6, 8)[:n].replace(" ", "-") for n in (SIZE - 2, SIZE - 1, SIZE, SIZE + 1)]
    rows, shared = [], {}
    for passage in passages:
        # Neither byte beside the passage is the same in both documents.
        for left, right in ("<>", "[]"):
            shared[len(rows)] = len(passage.encode())
            rows.append((len(rows), f"{words(rng, rng.randint(20, 90), 2, 9)} {left}{passage}{right} "
                                    f"{words(rng, rng.randint(20, 90), 2, 9)}"))
    for _ in range(20):
        shared[len(rows)] = 0
        rows.append((len(rows), words(rng, rng.randint(60, 250), 2, 9)))
    return rows, shared


def removed(rows):
    """The contract's rows by all windows of SIZE bytes."""
    raws = [(text or "").encode() for _, text in rows]
    seen = Counter(raw[i:i + SIZE] for raw in raws for i in range(len(raw) - SIZE + 1))
    for (doc_id, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - SIZE + 1):
            if seen[raw[i:i + SIZE]] > 1:
                gone[1 + i:1 + i + SIZE] = 1
        kept = np.frombuffer(raw, np.uint8)[gone[1:-1] == 0].tobytes()
        yield doc_id, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_planted_passages(spark, tmp_path):
    from careops.llm.queries import op1_suffix_dedup

    rng = random.Random(21)
    rows, shared = planted(rng)
    twice = words(rng, 70, 6, 8)
    more = [None, "", f"{twice}|{twice}", f"<{words(rng, 9, 3, 8)}>", "line of a table\n" * 60]
    rows += [(len(rows) + i, text) for i, text in enumerate(more)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows))
    by_id = {r.doc_id: r for r in got}
    few = [i for i, n in shared.items() if 0 < n < SIZE]
    many = [i for i, n in shared.items() if n >= SIZE]
    assert len(few) > 16 and len(many) > 16
    assert all(by_id[i].n_removed == 0 for i, n in shared.items() if n < SIZE)
    assert all(by_id[i].n_removed == shared[i] and by_id[i].n_spans == 1 for i in many)
    assert all(r.n_bytes == len((text or "").encode()) for (i, text) in rows for r in [by_id[i]])
