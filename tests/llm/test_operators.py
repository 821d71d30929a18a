"""The operators against brute force on small tables: nulls, empty texts, ties, repeats, extra columns, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from careops.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, id string, t int"


def make_docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(40), text(60)
    texts = [None, "", "   ", "a", "!!! 12", "aa " * 600, base, base, base + " tail", base.replace(" ", "\n", 1), base,
             shared, text(30) + " " + shared + " " + text(20), shared + text(9), text(3000)]
    texts += [text(rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None, "a", "a"][i % 6]) for i, t in enumerate(texts)]
    rows += [rows[6], rows[0], (None, "no id " + shared, None, None), (None, None, "en", "b")]
    return [(*r, 0 if r[1] is None else len(r[1]), "clash", 7, "x", 1) for r in rows]


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ranked(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("keep,group", [("none", 16384), ("first", 16384), ("none", 1), ("first", 1)])
def test_suffix_dedup(docs, keep, group):
    from careops.llm.suffix_dedup import dedup_digest

    size, order = 60, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, xxhash_long(r[1])))
    places = {}
    for k, r in enumerate(order):
        raw = (r[1] or "").encode()
        for i in range(len(raw) - size + 1):
            places.setdefault(raw[i:i + size], []).append((k, i))
    want = []
    for k, r in enumerate(order):
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - size + 1):
            at = places[raw[i:i + size]]
            if len(at) > 1 and (keep == "none" or (k, i) > at[0]):
                gone[1 + i:1 + i + size] = 1
        kept = np.frombuffer(raw, np.uint8)[gone[1:-1] == 0].tobytes()
        want.append((r[0], len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = dedup_digest(docs, size, keep, gram=16, group=group).collect()
    assert ranked(got) == ranked(want)


def test_previous_factors():
    from careops.llm.suffix_dedup import previous_factors

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (1, 2, 7, 40, 150)] + ["a" * 60, "ab" * 30, "abcde"]
    for text in texts:
        order = sorted(range(len(text)), key=lambda i: text[i:])
        lcp = [0] + [shared(text[a:], text[b:]) for a, b in zip(order, order[1:])]
        got = previous_factors(np.array(order), np.array(lcp))
        want = [max((shared(text[i:], text[j:]) for j in range(i)), default=0) for i in order]
        assert got.tolist() == want


def xxhash_long(text):
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def test_suffix_documents_keep_columns_and_valid_text(docs):
    from careops.llm.suffix_dedup import dedup_documents

    out = dedup_documents(docs, 60, gram=16)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in out.collect())


def test_simhash(docs):
    from careops.llm.simhash import near_duplicates

    def fingerprint(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r[1]) for r in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = [(r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(ROWS)]
    assert ranked(near_duplicates(docs).collect()) == ranked(want)


def test_keep_first_keeps_one_row_of_every_group(spark):
    from careops.llm.simhash import keep_first, near_duplicates

    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (6, b, "x"), (None, c, "x"), (None, c, "x"), (9, c, "x"),
            (7, None, "x"), (None, "", "x")]
    rows += [(None, text(), "x") for _ in range(8)] + [(5, text(), "x") for _ in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [tuple(r) for r in keep_first(docs).collect()]
    ids = {a: 3, b: 5, c: 9, None: 7}
    want = list(ids.items()) + [(t, i) for i, t, _ in rows[10:]]
    assert ranked((t, i) for i, t, _ in kept) == ranked(want)
    assert len(kept) == len({r.fingerprint for r in near_duplicates(docs).collect()})


def test_bit_sliced_pairs_equal_popcounts():
    from careops.llm.simhash import close_pairs

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    values = base[rng.integers(0, 40, 700)] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    groups = np.sort(np.concatenate([np.zeros(300, int), rng.integers(1, 60, 400)]))
    i, j = close_pairs(values, groups, 4)
    want = {(a, b) for a in range(700) for b in range(a + 1, 700)
            if groups[a] == groups[b] and int(values[a] ^ values[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_vectors(spark):
    from careops.llm.lattice_dedup import near_vectors
    from careops.llm.topk import top_k

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    vectors = [(i, (centers[i % 30] + 0.08 * rng.normal(size=16)).astype(float).tolist()) for i in range(150)]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, []), vectors[0], vectors[3]]
    df = spark.createDataFrame([(*r, 1, "c") for r in vectors + odd], "vec_id long, embedding array<double>, k int, v string")
    rows = near_vectors(df, 0.9, tables=16, block_rows=3).collect()
    assert len(rows) == 157
    real = [r for r in vectors + odd if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    x = np.array([r[1] for r in real])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    links = near.sum(1) - 1
    got = {r.vec_id: r for r in rows}
    found, wanted = sum(r.n_links for r in rows), int(links.sum())
    assert 0.9 * wanted <= found <= wanted
    assert got[201].n_links == 0 and got[202].component_id == 202 and got[200].kept
    k = 5
    top = top_k(df, F.col("vec_id") % 20 == 0, k=k, candidate_block=16, query_block=4).collect()
    whole = [(r[0], [math.floor(64 * c) for c in r[1]]) for r in vectors + odd
             if r[1] is not None and None not in r[1] and all(map(math.isfinite, r[1]))]
    want = []
    for q, a in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
        best = sorted((-sum(c * d for c, d in zip(a, b)), i) for i, b in whole if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert ranked(top) == ranked(want)


def test_mix(docs):
    from careops.llm.mixing import mix, mixed_documents

    documents, _ = mix(docs, block=4, shard=64, chunk_rows=5)
    rows = documents.collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    total, names = sum(sizes.values()), [*sorted(s for s in sizes if s is not None), None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    assert len(rows) == len(ROWS)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * total
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 16 for s in names)
    assert ranked(r[:] for r in mix(docs, block=4, shard=64, chunk_rows=5)[0].collect()) == ranked(r[:] for r in rows)
    out = mixed_documents(docs).collect()
    assert all(r.n_chars == len(r.text) for r in out)


def test_permutation_is_a_bijection(spark):
    from careops.llm.mixing import with_permutation

    for n in (1, 2, 7, 64, 997):
        df = spark.range(n).withColumn("p", F.col("id")).withColumn("n", F.lit(n).cast("long")).withColumn("s", F.lit(4))
        assert sorted(r.p for r in with_permutation(df, "p", "n", ["s"], 7).collect()) == list(range(n))


def test_pack_and_token_files(docs, spark, tmp_path):
    from careops.llm.packing import Capacity, pack_documents, pack_group
    from careops.llm.token_files import read_tokens, write_tokens
    from tokenizers import Tokenizer

    def ids(name, text):
        return [*Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids, 0]

    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    rows = pack_documents(docs, tokenizer("word_bpe_49k.json"), Capacity(tokens=512)).collect()
    want = []
    for r in ROWS:
        t = ids("word_bpe_49k.json", r[1])
        want += [(r[0], i // 512, i, len(t[i:i + 512]), crc(t[i:i + 512])) for i in range(0, len(t), 512)]
    assert ranked(r[:5] for r in rows) == ranked(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 512) + 2
    lengths = np.array([5, 5, 3, 3, 2, 2, 1])
    for rule in ("norm", "dot"):
        cap = Capacity(tokens=10, documents=3, attention=60, rule=rule)
        s, _, n = pack_group(lengths, cap)
        for k in range(n):
            own = lengths[s == k]
            assert own.sum() <= 10 and len(own) <= 3 and (own**2).sum() <= 60
    path = f"{tmp_path}/files"
    write_tokens(docs, path, tokenizer("byte_bpe_50k.json"))
    got = read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for g, r in zip(got, order, strict=True):
        t = ids("byte_bpe_50k.json", r[1])
        assert (g.id, g.start, g.n_tokens, g.ids_crc32, g.ids) == (r[0], at, len(t), crc(t), t)
        at += len(t)


def test_patched_blocks_round_trip():
    from careops.llm.token_files import pack_numbers, unpack_numbers

    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 1000):
        for high in (0, 1, 300, 2**32 - 1):
            values = rng.integers(0, high, n, dtype=np.uint32, endpoint=True)
            values[: n // 20] = rng.integers(0, 2**32 - 1, n // 20)
            body = pack_numbers(values)
            back, used = unpack_numbers(memoryview(body))
            assert (back == values).all() and used == len(body)


def test_encoder_equals_whole_texts():
    from careops.llm.encode import Encoder
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["".join(rng.choice("aAé Σßz.,'\"s t\n \t\r1!?中÷İ\x1ć") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        flat, sizes = Encoder(tokenizer(name)).encode(texts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        whole = Tokenizer.from_file(tokenizer(name)).encode_batch_fast(texts, add_special_tokens=False)
        assert all(e.ids == flat[at[i]:at[i + 1]].tolist() for i, e in enumerate(whole))


def test_encoder_keeps_added_tokens():
    from careops.llm.encode import Encoder
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext |>", "<|", "|>", " ", "  ", "\n", "\t", "é", "İ", "\0", "a",
             "Word", "it's", "!", "12"]
    texts = ["see <|endoftext|> here", "<|endoftext|>", *["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        flat, sizes = Encoder(tokenizer(name)).encode(texts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        whole = Tokenizer.from_file(tokenizer(name)).encode_batch_fast(texts, add_special_tokens=False)
        assert all(e.ids == flat[at[i]:at[i + 1]].tolist() for i, e in enumerate(whole))


def test_encoder_in_calls_of_any_size():
    from careops.llm.encode import Encoder
    from tokenizers import Tokenizer

    rng = random.Random(8)
    parts = ["\0", "\x01", "\x01 ", "\n", "\n\n", " ", "  ", "\t", "\u3000", "\u0301", "a", "é", "İ", "Σ", "Word", "it's", "1", "!",
             ". ", "中", "<|endoftext|>", "<|EndOfText|>"]
    texts = [None, "", "\0", "\x01", " ", *["".join(rng.choices(parts[1:] if i % 3 else parts, k=rng.randint(0, 15))) for i in range(2000)]]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(tokenizer(name)).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        for step in (1, 7, 3000):
            encoder, got = Encoder(tokenizer(name)), []
            for i in range(0, len(texts), step):
                flat, sizes = encoder.encode(texts[i:i + step])
                got += [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])]
            assert got == [e.ids for e in whole]


def test_encoder_looks_each_chunk_up_once_a_call(monkeypatch):
    from careops.llm.encode import JOINED, Encoder

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    rng = random.Random(9)
    words = [" " + "".join(rng.choices("abcdefgh", k=9)) for _ in range(4000)]
    text = "".join(words * 5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        given = []
        encoder, plain = Encoder(tokenizer(name)), Encoder._encoded
        monkeypatch.setattr(Encoder, "_encoded", lambda self, chunks: (given.extend(chunks), plain(self, chunks))[1])
        encoder.index = Counted()
        first = encoder.encode([text])[0]
        assert Counted.asked <= 2 * (len(set(words)) + 2)  # not for each of the 20,000 words
        assert len(given) <= len(set(words)) // JOINED + 3  # new words go to the library many in a call
        Counted.asked = 0
        assert (encoder.encode([text])[0] == first).all()
        assert Counted.asked <= len(set(words)) + 2
        Counted.asked = 0
        monkeypatch.undo()


def test_encoder_without_a_mark_of_its_own(monkeypatch):
    from careops.llm.encode import Encoder

    encoder = Encoder(tokenizer("word_bpe_49k.json"))
    other = encoder.tokenizer.encode("the", add_special_tokens=False).ids
    encoder.join = (" the ", "\x01", other[0])  # as where a word has the mark's id
    flat, _ = encoder.encode(["of the cat"])
    assert flat.tolist() == encoder.tokenizer.encode("of the cat", add_special_tokens=False).ids


def test_pair_lm(docs):
    from careops.llm.ngram_lm import score_texts

    rows = score_texts(docs, F.coalesce(F.col("doc_id"), F.lit(1)) % 7 != 2).collect()
    tokens = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    seen = Counter(w for r in ROWS if (1 if r[0] is None else r[0]) % 7 != 2 for w in tokens(r[1]))
    total, kinds = sum(seen.values()), len(seen)
    want = []
    for r in ROWS:
        t = tokens(r[1])
        base = sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in t)
        want.append((r[0], (1 if r[0] is None else r[0]) % 7 == 2, len(t), sum(seen[w] > 0 for w in t), total, round(base, 6)))
    assert ranked((*r[:5], round(r.base_score, 6)) for r in rows) == ranked(want)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pair_lm_gathers_no_pairs(docs, spark, monkeypatch):
    import pickle

    from careops.llm import ngram_lm

    sizes, sc = [], type(spark.sparkContext)
    real = sc.broadcast
    monkeypatch.setattr(sc, "broadcast", lambda self, value: sizes.append(len(pickle.dumps(value))) or real(self, value))
    ngram_lm.score_texts(docs.filter("doc_id < 3"))
    once = {(r.doc_id, round(r.base_score, 6)): r.score for r in ngram_lm.score_texts(docs).collect()}
    assert abs(sizes[0] - sizes[1]) < 64  # the same for every corpus
    monkeypatch.setattr(ngram_lm, "RANGE_ENTRIES", 200)
    cut = {(r.doc_id, round(r.base_score, 6)): r.score for r in ngram_lm.score_texts(docs).collect()}
    assert once.keys() == cut.keys()  # only the filter's false positives differ with the ranges
    assert all(abs(once[k] - cut[k]) <= 0.02 * abs(once[k]) + 0.5 for k in once)


def test_language_id(docs, spark):
    from careops.llm.langid import fit_languages, predict_languages

    rng = random.Random(1)
    alphabets = {"en": "abcdef", "fr": "éèghij", "de": "üöklmn"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(30)), lang)
            for i, (lang, a) in enumerate(list(alphabets.items()) * 20)]
    rows += [(100, None, "en"), (101, "12 !!", "en"), (102, "", None), (None, "abc def", None), (103, "ß", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in predict_languages(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:60])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[None].lang_pred == "en" and got[103].lang_pred in alphabets
    nothing = fit_languages(df.limit(0))
    assert {r.lang_pred for r in predict_languages(df, nothing).collect()} == {"und"}


def test_language_rejection(spark):
    from careops.llm.langid import fit_languages, predict_languages

    rows = [(i, ("abc fed " if i % 2 else "xyz wvu ") * 20, ["fr", "en"][i % 2]) for i in range(20)]
    rows += [(30, "abc fed " * 3 + "qrs tmn " * 12, None), (31, "ßßß", None), (32, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(df)
    every = {r.doc_id: r for r in predict_languages(df, model).collect()}
    got = {r.doc_id: r for r in predict_languages(df, model, reject_below=0.9).collect()}
    assert every[30].lang_pred != "und" and every[31].lang_pred != "und"
    for i, r in got.items():
        assert r.score == every[i].score
        assert r.lang_pred == (every[i].lang_pred if r.score >= 0.9 else "und")
    assert all(got[i].lang_pred == "und" for i in (30, 31, 32)) and all(got[i].lang_pred != "und" for i in range(20))


def test_quality(docs, spark):
    from careops.llm.quality import fit_quality, keep_good, score_quality

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        good = i % 3 > 0
        rows.append((i, " ".join(words if good else [w + "$$$" for w in words])))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in score_quality(df, fit_quality(df, marks, F.col("doc_id") % 5 != 0)).collect()}
    assert sum((scored[i] >= 0.3) == bool(y) for i, y in labels) >= 396
    kept = keep_good(df, marks)
    assert kept.columns == df.columns and kept.count() < 300
    assert score_quality(docs, fit_quality(docs, marks.limit(0))).count() == len(ROWS)


def test_empty_tables(no_docs, spark):
    from careops.llm import langid, mixing, ngram_lm, packing, quality, simhash, suffix_dedup
    from careops.llm.lattice_dedup import near_vectors
    from careops.llm.topk import top_k

    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (suffix_dedup.dedup_digest(no_docs), simhash.near_duplicates(no_docs), simhash.keep_first(no_docs),
               mixing.mix(no_docs)[0], mixing.mixed_documents(no_docs), ngram_lm.score_texts(no_docs),
               packing.pack_documents(no_docs, tokenizer("word_bpe_49k.json")),
               langid.predict_languages(no_docs, langid.fit_languages(no_docs)),
               quality.score_quality(no_docs, quality.fit_quality(no_docs, labels)),
               near_vectors(vectors), top_k(vectors, F.col("vec_id") % 20 == 0)):
        assert df.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from careops.llm.common import stored
    from careops.llm.simhash import near_duplicates
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF_SMALL), name)
        assert after.columns == columns and 0 < after.count()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            classes = near_duplicates(before).collect()
            assert ids == {r.component_id for r in classes}
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert rows.agg(F.max("n")).first()[0] <= 2048


def test_lattice_recall_at_the_query_settings(spark):
    """Planted pairs at cosine 0.90 to 0.95, in 64 components: at least nine tenths found, and nothing below 0.9."""
    from careops.llm.lattice_dedup import near_vectors

    rng = np.random.default_rng(11)
    base = rng.normal(size=(800, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.95, (800, 1))
    near = cosine * base + np.sqrt(1 - cosine ** 2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    out = {r.vec_id: r for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    vectors = np.concatenate([base, near])
    linked = vectors @ vectors.T >= 0.9
    np.fill_diagonal(linked, False)
    wanted, found = int(linked.sum()), sum(r.n_links for r in out.values())
    assert len(out) == 1600 and 0.9 * wanted <= found <= wanted
    assert all(out[i].n_links <= linked[i].sum() for i in range(1600))
