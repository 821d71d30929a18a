"""Byte-pair encoding by speculation: propose greedily, verify every adjacent pair, merge only what fails.

A sequence of tokens is the byte-pair encoding of a word exactly if every
token is the encoding of its own bytes and every two neighbours stay apart
when they are encoded together.  So, for all new words of a batch at once:

1. *Propose.*  The longest token that starts at each place of the words is
   found by walking a trie from all places together; following the longest
   tokens from a word's start gives its proposal.
2. *Verify.*  For every adjacent pair the merges along the boundary are
   undone, latest first, in all pairs together; a pair fails where a merge
   across the boundary would have come before one that was undone.
3. *Merge.*  Words with a failing pair, and only those, are merged exactly by
   rank with a heap.

Texts are cut into words by the tokenizer's own normaliser and splitting
rule (plain ASCII words by the same rule as a regular expression), and words
met before are looked up (``encode.Encoder``).  The ``tokenizers`` library's
model is never asked for ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.llm.common import byte_column, python_batches, slices
from careops.llm.encode import Encoder

# Longer texts are encoded and decoded in parts that end at a space.
PART_CHARS = 1 << 20
PART_IDS = 1 << 18
NEVER = np.int64(1) << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """The merge rules of a byte-pair vocabulary as arrays over token ids.

    ``first``/``second`` are the parts a token is merged from and ``rank`` the
    place of that rule (-1 for single symbols).  ``sound`` tokens are the
    encoding of their own symbols; only they are proposed.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        size = max(vocab.values()) + 1
        self.first, self.second = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        rules = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        made = rules[:, 2]
        if len(np.unique(made)) != len(made):
            raise ValueError("a token that two rules make is not supported")
        self.first[made], self.second[made], self.rank[made] = rules[:, 0], rules[:, 1], np.arange(len(rules))
        self.size = size
        keys = rules[:, 0] * size + rules[:, 1]
        order = np.argsort(keys)
        self._pairs, self._made = keys[order], made[order]
        self.rule = {(a, b): (r, t) for r, (a, b, t) in enumerate(rules.tolist())}
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)  # a byte inside a word
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)  # a word's last byte
        own = self.stays_apart(rules[:, 0], rules[:, 1], 2 * np.arange(len(rules)))
        self.sound = np.zeros(size, bool)
        self.sound[np.concatenate([self.inner, self.last])] = True
        symbols: dict[int, tuple[int, ...]] = {s: (s,) for s in [*self.inner.tolist(), *self.last.tolist()]}
        for (a, b, t), fine in zip(rules.tolist(), own.tolist()):
            symbols[t] = symbols[a] + symbols[b]
            self.sound[t] = fine and self.sound[a] and self.sound[b]
        self._trie(symbols)

    def _trie(self, symbols: dict[int, tuple[int, ...]]) -> None:
        tokens = np.array([t for t in symbols if self.sound[t]], np.int64)
        lengths = np.array([len(symbols[t]) for t in tokens.tolist()], np.int64)
        flat = np.array([s for t in tokens.tolist() for s in symbols[t]], np.int64)
        starts = np.cumsum(lengths) - lengths
        node = np.zeros(len(tokens), np.int64)
        keys, nodes, ends = [], [], {}
        made = 1
        for depth in range(int(lengths.max())):
            deep = np.flatnonzero(lengths > depth)
            key, at = np.unique(node[deep] * self.size + flat[starts[deep] + depth], return_inverse=True)
            node[deep] = made + at
            keys.append(key)
            nodes.append(made + np.arange(len(key)))
            made += len(key)
            for k in np.flatnonzero(lengths == depth + 1).tolist():
                ends[int(node[k])] = int(tokens[k])
        edges, to = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(edges)
        self._edges, self._to = edges[order], to[order]
        self._ends = np.full(made, -1, np.int64)
        self._ends[list(ends)] = list(ends.values())
        self._root = np.full(self.size, -1, np.int64)  # the first step, without a search
        top = self._edges[self._edges < self.size]
        self._root[top] = self._to[:len(top)]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, -1 where there is no rule."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._made[at], -1)

    def stays_apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the encoding of ``a``'s and ``b``'s symbols in a row keeps the boundary.

        ``before``: only merges earlier than that count (twice the rank).  A
        merge on the left of the boundary comes before one of equal rank
        across it, and that before one on its right: so an undone left merge
        of rank r leaves the time 2r to a merge across of time 2q < 2r, and an
        undone right one the time 2r + 1.
        """
        apart = np.ones(len(a), bool)
        if not len(self._pairs):
            return apart
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            token = self.merged(x, y)
            crosses = (token >= 0) & (2 * self.rank[token] < limit)
            apart[live[crosses]] = False
            left, right = 2 * self.rank[x], 2 * self.rank[y] + 1
            go = ~crosses & ((left >= 0) | (right >= 0))
            live, x, y, left, right = live[go], x[go], y[go], left[go], right[go]
            undo_left = left > right
            limit = np.maximum(left, right)
            x = np.where(undo_left, self.second[x], x)
            y = np.where(undo_left, y, self.first[y])
        return apart

    def propose(self, symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of the greedy longest matches in words end to end; ``stop`` is the end of each place's word."""
        n = len(symbols)
        best, reach = symbols.copy(), np.ones(n, np.int64)
        live = np.arange(n)
        node = self._root[symbols]
        depth = 1
        while True:
            inside = live + depth < stop[live]
            live, node = live[inside], node[inside]
            if not len(live):
                break
            key = node * self.size + symbols[live + depth]
            at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            found = self._edges[at] == key
            live, node = live[found], self._to[at[found]]
            depth += 1
            token = self._ends[node]
            ends = token >= 0
            best[live[ends]], reach[live[ends]] = token[ends], depth
        follow = (np.arange(n) + reach).tolist()
        places, p = [], 0
        while p < n:
            places.append(p)
            p = follow[p]
        places = np.array(places, np.int64)
        return places, best[places]

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word: the lowest rank first, the leftmost of equal ones."""
        n, rule = len(symbols), self.rule
        token = list(symbols)
        back, ahead = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            got = rule.get((token[i], token[i + 1]))
            if got:
                heap.append((got[0], i, got[1], token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, t, a, b = heapq.heappop(heap)
            j = ahead[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = t, -1
            ahead[i] = k = ahead[j]
            if k < n:
                back[k] = i
                got = rule.get((t, token[k]))
                if got:
                    heapq.heappush(heap, (got[0], i, got[1], t, token[k]))
            h = back[i]
            if h >= 0:
                got = rule.get((token[h], t))
                if got:
                    heapq.heappush(heap, (got[0], h, got[1], token[h], t))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, ids of each word, which words failed the check) of words of at least one byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        places, tokens = self.propose(symbols, np.repeat(ends, sizes))
        word = np.searchsorted(ends, places, "right")
        beside = np.flatnonzero(word[1:] == word[:-1])
        wrong = beside[~self.stays_apart(tokens[beside], tokens[beside + 1])]
        failed = np.zeros(len(words), bool)
        failed[word[wrong]] = True
        counts = np.bincount(word, minlength=len(words))
        if not failed.any():
            return tokens, counts, failed
        parts, cuts = [], np.concatenate([[0], np.cumsum(counts)])
        done = 0
        for w in np.flatnonzero(failed).tolist():
            parts.append(tokens[cuts[done]:cuts[w]])
            parts.append(np.array(self.merge(symbols[ends[w] - sizes[w]:ends[w]].tolist()), np.int64))
            counts[w] = len(parts[-1])
            done = w + 1
        parts.append(tokens[cuts[done]:])
        return np.concatenate(parts), counts, failed


class SpeculativeEncoder(Encoder):
    """An ``Encoder`` whose new words are encoded by ``Merges``; it also decodes.

    For tokenizer files with byte-pair merges and byte-level words.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get(
                "continuing_subword_prefix") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a plain byte-pair tokenizer without decoder")
        self.join = None
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        names = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        spelled = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.spell_sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.spell_starts = np.cumsum(self.spell_sizes) - self.spell_sizes
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        rule = [p["pattern"].get("Regex", "") for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # The file's rule, its letter and digit classes cut to ASCII, for plain ASCII chunks.
        plain = rule[0].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", "\t\n\v\f\r ") if len(rule) == 1 else None
        self.plain = re.compile(plain.encode()) if plain and "\\" not in plain else None

    def words(self, chunk: str) -> list[bytes]:
        """The words that the tokenizer cuts a chunk without added tokens into."""
        if self.plain is not None and chunk.isascii():
            return [chunk.lower().encode()] if chunk.isalpha() else self.plain.findall(chunk.lower().encode())
        text = self.tokenizer.normalizer.normalize_str(chunk)
        return [text[a:b].encode() for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [[] if c in self.special else self.words(c) for c in chunks]
        words = list(dict.fromkeys(w for part in cut for w in part))
        place = {w: k for k, w in enumerate(words)}
        if not words:
            ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            ids, counts, _ = self.merges.encode_words(words)
        # One more "word" for each added token, after the others.
        special = list(self.special.values())
        ids, counts = np.concatenate([ids, special]).astype(np.int64), np.concatenate(
            [counts, np.ones(len(special), np.int64)]).astype(np.int64)
        extra = {t: len(words) + k for k, t in enumerate(self.special)}
        at = np.array([k for c, part in zip(chunks, cut)
                       for k in ([extra[c]] if c in extra else [place[w] for w in part])], np.int64)
        per = np.fromiter((1 if c in extra else len(part) for c, part in zip(chunks, cut)), np.int64, len(chunks))
        starts = np.cumsum(counts) - counts
        sizes = counts[at]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].astype(np.uint32)
        upto = np.concatenate([[0], ends])
        return flat, np.diff(upto[np.concatenate([[0], np.cumsum(per)])])

    def parts(self, text: str) -> list[str]:
        """Parts of a long text; cutting at a space changes no ids."""
        out, at = [], 0
        while len(text) - at > PART_CHARS:
            end = text.find(" ", at + PART_CHARS)
            if end < 0 or self.cut == self._whole:
                break
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` with long texts taken in parts, so that its working memory stays small."""
        cut = [self.parts(t or "") for t in texts]
        flat, counts = [], []
        held: list[str] = []
        size = 0
        for part in (p for some in cut for p in some):
            held.append(part)
            size += len(part)
            if size >= PART_CHARS:
                ids, n = self.encode(held)
                flat.append(ids)
                counts.append(n)
                held, size = [], 0
        ids, n = self.encode(held)
        every, sizes = np.concatenate([*flat, ids]), np.concatenate([*counts, n])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return every, np.diff(upto[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded ids: their spellings with a space between, special tokens included."""
        out = []
        for i in range(0, len(ids), PART_IDS):
            some = ids[i:i + PART_IDS].astype(np.int64)
            sizes = self.spell_sizes[some]
            ends = np.cumsum(sizes)
            out.append(self.spelling[np.repeat(self.spell_starts[some] - (ends - sizes), sizes)
                                     + np.arange(int(ends[-1]))].tobytes())
        return b"".join(out)[:-1]


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and their decoded text.

    Null and empty texts, and texts of white space, have no ids and decode to
    the empty text; a text of any length is encoded whole (in parts that end
    at a space).  Rows are independent: null ids, ties and repeated rows keep
    their rows; an empty table gives none; other columns are ignored, whatever
    their names.  ``tokenizer`` is the path of a tokenizer file, the same on
    every machine that runs Python.
    """
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpeculativeEncoder.of(tokenizer)
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                ids, counts = encoder.encode_all(batch.column(1).slice(i, j - i).to_pylist())
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i),
                    pa.array([bytes(raw[4 * a:4 * b]) for a, b in zip(at, at[1:])], pa.binary()),
                    pa.array([encoder.decode(ids[a:b]) for a, b in zip(at, at[1:])], pa.binary()).cast(pa.string()),
                ], names=["id", "ids", "decoded"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
