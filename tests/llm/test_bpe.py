"""Speculative byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from careops.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    from careops.llm.bpe import SpeculativeEncoder

    return SpeculativeEncoder.of(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def some_texts():
    rng = random.Random(3)
    texts = [None, "", "  \n\t ", "a", "a <|endoftext|> b", "<|ENDOFTEXT|>x it's I'LL we're 'd '", "x" * 3000,
             "ab" * 500 + " é" * 90, "İstanbul ΣΑΣ ﬁ", "日本語テキスト １２３ ½ ²", "áé ẛ̣", "\x1c\x1d a\x00b \x85 c d",
             "..!!..;;a;b|c", "🙂🙂 👨‍👩‍👧 a🙂b", "<|startoftext|><|endoftext|>", "tail " * 4000]
    texts += ["".join(rng.choice("abcdeinrstio'.,!0129 \n\té漢ßİ́|<>_-") for _ in range(rng.randint(0, 40)))
              for _ in range(400)]
    return texts + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_ids_equal_the_library(encoder, library):
    texts = some_texts()
    ids, counts = encoder.encode_all(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        own = ids[at[i]:at[i + 1]]
        assert own.tolist() == want, text
        assert encoder.decode(own).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aehilnorstuéß' .0", max_size=60))
def test_any_text(encoder, library, text):
    assert encoder.encode_all([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_token_is_judged_as_exact_merging_does(encoder):
    merges = encoder.merges
    symbols = {s: [s] for s in [*merges.inner.tolist(), *merges.last.tolist()]}
    rng = random.Random(2)
    made = np.argsort(merges.rank)[(merges.rank < 0).sum():]
    for t in made.tolist():
        symbols[t] = symbols[int(merges.first[t])] + symbols[int(merges.second[t])]
    for t in rng.sample(sorted(symbols), 3000):
        assert bool(merges.sound[t]) == (merges.merge(symbols[t]) == [t])
    inner = [t for t in symbols if symbols[t][-1] in set(merges.inner.tolist()) and merges.sound[t]]
    a, b = (np.array(rng.choices(some, k=3000)) for some in (inner, [t for t in symbols if merges.sound[t]]))
    for x, y, apart in zip(a.tolist(), b.tolist(), merges.stays_apart(a, b).tolist()):
        assert apart == (merges.merge(symbols[x] + symbols[y]) == [x, y])


def test_small_rules_with_ties():
    """Repeated letters, where equal ranks meet at the boundary, and a token that no encoding gives."""
    from careops.llm.bpe import Merges, byte_letters

    vocab = {x: i for i, x in enumerate(byte_letters())}
    rules = ["a a", "b c", "a b", "aa a", "ab c", "aa aa"]
    for r in rules:
        vocab[r.replace(" ", "")] = len(vocab)
    merges = Merges(vocab, rules)
    assert not merges.sound[vocab["abc"]]  # "b c" comes first
    rng = random.Random(1)
    words = ["".join(rng.choice("aabc") for _ in range(rng.randint(1, 12))).encode() for _ in range(2000)]
    ids, counts, failed = merges.encode_words(words)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert 0 < failed.sum() < len(words)
    for i, w in enumerate(words):
        assert ids[at[i]:at[i + 1]].tolist() == merges.merge(merges.inner[np.frombuffer(w, np.uint8)].tolist())


def test_long_texts_go_in_parts(encoder, library, monkeypatch):
    from careops.llm import bpe

    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    monkeypatch.setattr(bpe, "PART_IDS", 7)
    text = " ".join(t or "" for t in some_texts()[:14])
    ids, counts = encoder.encode_all([text, None, "short", text])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids[:counts[0]].tolist() == want == ids[-counts[3]:].tolist() and counts[1] == 0
    assert encoder.decode(ids[:counts[0]]).decode() == library.decode(want, skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    from careops.llm.bpe import SpeculativeEncoder

    with pytest.raises(ValueError):
        SpeculativeEncoder(tokenizer("byte_bpe_50k.json"))


def test_query_rows(spark, library, tmp_path):
    """The registered query on a table with nulls, repeats, clashing columns, and on an empty one."""
    from careops.llm.queries import op11_speculative_bpe

    texts = some_texts()[:80]
    rows = [(i, t, "x", 1, b"1") for i, t in enumerate(texts)] + [(None, "no id", "y", None, None), (3, "a", None, 1, None)]
    schema = "doc_id long, text string, ids string, id int, decoded binary"
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = op11_speculative_bpe(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        want = []
        for r in some:
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
