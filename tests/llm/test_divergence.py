"""Source divergence against brute force in Python integers, and the perfect hash that it uses."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, shard int, value string, item int"


def brute(rows, min_docs, top=10):
    docs, counts, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(c):
            by = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // by for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x[2], -x[0], k + 1) for k, x in enumerate(found)]
    return out


def make_rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcDEFéü漢") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["a", "b", "c", None, "Z", "é", "hot", "hot"])
        some = words[:40] if source == "hot" else words
        rows.append((i, rng.choice([" ", "\n", "1", "_", "\x00"]).join(rng.choices(some, k=rng.randint(0, 30))), lang, source))
    rows += [(900, None, "en", "none"), (901, "", "xx", "only"), (902, "rare words", "xx", "two"), (903, "!!! 12", None, None)]
    rows += [rows[5], rows[5], (None, "Long " * 3000 + "x" * 5000, "en", "a")]
    rows += [(2000 + i, "same Same SAME tie", "tt", f"s{i % 3}") for i in range(12)]
    return [(*r, "t", 1, 2, "v", 3) for r in rows]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "shard_terms": 9}, {"shard_terms": 9}])
def test_divergence(spark, options, monkeypatch):
    from careops.llm import divergence

    if options:  # small blocks, pieces and buffers, so that every kind of cut is met
        for name, size in (("SOURCE_BLOCK", 3), ("PIECE_SLOTS", 5), ("HELD_TERMS", 50), ("HELD_SLOTS", 40), ("TEXT_PART", 64)):
            monkeypatch.setattr(divergence, name, size)
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.source_divergence(df, min_docs=10, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 10))


def test_empty_and_constant_tables(spark):
    from careops.llm.divergence import source_divergence

    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, None, None, None, "t", 1, 2, "v", 3) for i in range(3)]
    assert source_divergence(spark.createDataFrame(rows, SCHEMA)).count() == 0  # one group, no pair, no term


def test_share_is_exact(spark):
    from pyspark.sql import functions as F

    from careops.llm.divergence import difference, share

    rng = random.Random(1)
    rows = [(rng.randint(0, 10 ** k), rng.randint(0, 10 ** 12), rng.randint(1, 10 ** 6)) for k in range(12) for _ in range(20)]
    rows = [(c, max(n, c), v) for c, n, v in rows] + [(0, 0, 0), (0, 0, 1), (10 ** 15, 10 ** 15, 1)]
    df = spark.createDataFrame(rows, "c long, n long, v long").withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
    for r in df.withColumn("f", difference(F.col("p"), F.lit(7))).collect():
        if r.n + 2 * r.v:
            assert r.p == 1 + 10 ** 9 * (r.c + 2) // (r.n + 2 * r.v)
            assert r.f == (r.p - 7) ** 2 // (r.p + 7)


def test_perfect_hash():
    from careops.llm.divergence import term_hash
    from careops.llm.perfect_hash import PerfectHash

    keys = [f"w{i}".encode() for i in range(5000)] + [b"", "é".encode()]
    own = PerfectHash.load(PerfectHash.build(keys, term_hash(keys)).dump())
    slots = own.slots(keys, term_hash(keys))
    assert sorted(slots.tolist()) == list(range(len(keys))) and [own.keys[s] for s in slots] == keys
    others = [f"x{i}".encode() for i in range(5000)]
    assert (own.slots(others, term_hash(others)) == -1).all()
    # Keys that their hashes do not tell apart are found by their stored bytes.
    same = np.zeros(4, np.uint64)
    odd = PerfectHash.load(PerfectHash.build([b"a", b"b", b"c", b"d"], same).dump())
    assert sorted(odd.slots([b"a", b"b", b"c", b"d"], same).tolist()) == [0, 1, 2, 3]
    assert odd.slots([b"e"], same[:1]).tolist() == [-1]
    none = PerfectHash.load(PerfectHash.build([], np.zeros(0, np.uint64)).dump())
    assert len(none) == 0 and none.slots([b"a"], same[:1]).tolist() == [-1]
