"""The pipeline's stages on awkward tables: clashing names, equal rows, null ids, hot ids, empty tables, shared passages."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["score", "row", "id", "h", "x", "y", "p", "m", "w", "r", "key", "spans", "whole", "place", "times", "block",
         "size", "off", "sid", "taken", "text_hash", "first_id", "span_h", "copy_id", "fp", "root", "least", "component",
         "__id", "__h", "__h2", "__text", "__spans", "__p", "__w", "__m", "__r", "__pass", "odd name", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "ing", "ed"]) for _ in range(n))


def make_rows():
    rng = random.Random(11)
    shared = prose(rng, 80)
    rows = [(i, prose(rng, rng.randint(30, 200)), "en", rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 40), "en", "a") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, "  ", "en", "b"), (None, prose(rng, 50), None, None),
             (None, prose(rng, 60), "en", "b"), (203, "long " * 9000, "en", "a"), rows[3], rows[3]]
    rows += [(300, prose(rng, 90, 30), "en", "hot") for _ in range(30)]  # one id over many texts
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n)
                            for n in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")


def stages(labels):
    from careops.llm import mixing, quality, simhash, suffix_dedup

    return {
        "quality": lambda d: quality.keep_good(d, labels, 0.0),
        "simhash": simhash.keep_first,
        "suffix": lambda d: suffix_dedup.dedup_documents(d, 200),
        "mixing": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix", "mixing"])
def test_extra_columns_come_back_as_they_were(clashing, labels, name):
    out = stages(labels)[name](clashing)
    assert out.schema.names == clashing.schema.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    rows = out.collect()
    assert rows
    for r in rows:
        got = r.asDict()
        assert all(got[n] == f"{n}:{'null' if r.doc_id is None else r.doc_id}" for n in NAMES)
        assert (r.n_chars or 0) == len(r.text or "")


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix", "mixing"])
def test_empty_tables(clashing, labels, name):
    out = stages(labels)[name](clashing.limit(0))
    assert out.columns == clashing.columns and out.count() == 0


def test_one_of_equal_rows_keeps_its_text(spark):
    from careops.llm.suffix_dedup import dedup_digest, dedup_documents

    text = prose(random.Random(1), 80)
    rows = [(1, text, "en", s, len(text)) for s in ("a", "a", "b")] + [(2, text, "en", "a", len(text)), (None, text, None, None, None)]
    rows += [(3, None, None, None, None)] * 2 + [(4, "", None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    left = [len(r.text) for r in dedup_documents(df, 200).collect() if r.text]
    assert left == [len(text)]
    digest = dedup_digest(df, 200, keep="first").collect()
    assert sorted(r.n_removed for r in digest if r.n_bytes) == [0] + [len(text)] * 4
    assert len(digest) == len(rows)


def test_no_passage_of_fifty_words_survives_twice(spark):
    """The stage's own length, on passages planted at word and byte offsets, and on the test table."""
    import corpus_pipeline
    from tests.conftest import SF_CHECK

    rng = random.Random(3)
    passages = [" ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(51)) for _ in range(4)]
    rows = [(i, prose(rng, rng.randint(0, 60)) + " " + passages[i % 4] + ", " + prose(rng, 50), "en", "a", 1) for i in range(24)]
    made = spark.createDataFrame(rows, SCHEMA)
    real = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    for docs in (made, real):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        after = {r.doc_id: r.text or "" for r in corpus_pipeline.repeated_strings(spark, docs, SF_CHECK).collect()}
        assert before.keys() == after.keys()
        seen, twice = {}, set()
        for i, text in before.items():
            w = WORD.findall(text)
            for k in range(len(w) - 50):
                if seen.setdefault(" ".join(w[k:k + 51]), i) != i:
                    twice.add(" ".join(w[k:k + 51]))
        assert twice
        holders = {}
        for i, text in after.items():
            w = WORD.findall(text)
            for k in range(len(w) - 50):
                window = " ".join(w[k:k + 51])
                if window in twice:
                    holders.setdefault(window, set()).add(i)
        assert all(len(h) == 1 for h in holders.values())


def test_hot_ids_do_not_swell_the_fits(spark, monkeypatch):
    from careops.llm import langid, quality

    rng = random.Random(5)
    rows = [(7, prose(rng, 20), "en", "a", 1) for _ in range(400)] + [(i, prose(rng, 20), "en", "a", 1) for i in range(100, 150)]
    rows += [rows[0]] * 200
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: (sizes.append(len(x)), fit(x, y, **k))[1])
    marks = spark.createDataFrame([(7, 1)] * 50 + [(i, i % 2) for i in range(100, 150)], "doc_id long, quality int")
    quality.fit_quality(docs, marks)
    quality.fit_quality(docs, marks, sample=10)
    assert sizes[0] == 51 and sizes[1] < 25
    model = langid.fit_languages(docs, sample=20)
    assert model.langs and set(model.langs) == {"en"}


def test_packing_with_all_capacities_takes_no_more_sequences():
    import numpy as np

    from careops.llm.packing import Capacity, pack_group

    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2048, 4000), rng.integers(1, 60, 4000), np.minimum(2047, rng.geometric(0.004, 4000))):
        bound = -(-int(lengths.sum()) // 2048)
        only = pack_group(lengths, Capacity(tokens=2048))[2]
        sequence, offset, every = pack_group(lengths, Capacity(tokens=2048, documents=2048, attention=2048 ** 2))
        assert bound <= every <= only + max(1, only // 200)
        assert np.bincount(sequence, lengths).max() <= 2048


def test_whole_pipeline_on_an_empty_and_an_awkward_table(spark, clashing, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("none", clashing.limit(0)), ("awkward", clashing.drop("odd name", "a.b"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "awkward")
        ends = {}
        for r in rows:
            ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in ends.values():
            parts.sort()
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
            assert sum(p[1] for p in parts) <= 2048
