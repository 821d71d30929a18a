"""Token ids of whole texts with the ``tokenizers`` library, faster by remembering words.

A tokenizer that splits at spaces first gives the same ids whether a text is
encoded whole or cut at those places.  Texts are cut there, distinct chunks
are encoded once and looked up after that: once for each call, in which Arrow
numbers the chunks.  Which cuts hold is found from the tokenizer's own
pre-tokenizer; any other tokenizer encodes whole texts.
Added tokens ('<|endoftext|>'), which the tokenizer looks for in the text
before anything else, are set apart first.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

CACHE_CHUNKS = 800_000
LEARN_CHUNKS = 16_384
JOINED = 64
# Bytes of text that callers give in one call: chunks repeat in it, and its arrays stay at some ten times that.
CALL_BYTES = 1 << 22

# Every white-space character of Python's str (a superset of the tokenizers'), space left out.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
# A NUL marks cuts; texts that hold one are cut at spaces only.
_CUT = "\0"
_GAP = re.compile(r"(?<=\S)(?= )")
# Stands between chunks that are encoded in one call where white space is no token: a word of its own between spaces.
_BETWEEN = "\1"
_LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
_MARK = re.compile("[!#$%&*,.:;?|](?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff].)")


class Encoder:
    """Encodes lists of texts to flat ids; one per Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What may stand between chunks encoded in one call, the character that chunks must not hold, and its id.
        self.join: tuple[str, str, int] | None = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        whole_space = any(p.get("type") == "Split" and p.get("invert") for p in pre.get("pretokenizers", []))
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.cut = self._before_spaces
            self._join_by("\n", "\n")
        elif whole_space and "\\s" not in "".join(
                p["pattern"].get("Regex", "") for p in pre["pretokenizers"] if p.get("type") == "Split").replace("[^\\s", "["):
            self.cut = self._at_spaces  # white space is never part of a token
            self._join_by(f" {_BETWEEN} ", _BETWEEN)
        else:
            self.cut = self._whole
        added = spec.get("added_tokens") or []
        self.added = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        if any(t.get(x) for t in added for x in ("normalized", "single_word", "lstrip", "rstrip")) or any(
                c.isspace() for t in self.added for c in t):  # found in other ways than as they stand
            self.cut, self.join, self.added = self._whole, None, []
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _join_by(self, between: str, mark: str) -> None:
        ids = self.tokenizer.encode(between, add_special_tokens=False).ids
        if len(ids) == 1:
            self.join = between, mark, ids[0]

    @staticmethod
    def _whole(text: str) -> str:
        return text

    def _marked(self, text: str) -> str:
        """The chunks of a text without NUL, each with a cut after it.

        Added tokens are chunks, and what stands between them is cut like a text of its own.
        """
        if not any(t in text for t in self.added):
            return self.cut(text) + _CUT
        return "".join((part if k % 2 else self.cut(part)) + _CUT for k, part in enumerate(self.apart.split(text)) if part)

    def _chunks(self, text: str) -> list[str]:
        """The chunks of any text."""
        if _CUT not in text:
            return self._marked(text).split(_CUT)[:-1]
        parts = self.apart.split(text) if self.added else [text]
        return [c for k, part in enumerate(parts) if part
                for c in ([part] if k % 2 or self.cut == self._whole else _GAP.split(part))]

    @staticmethod
    def _before_spaces(text: str) -> str:
        """Cut before runs of white space that start with a space, around single line ends, before marks after letters.

        White space after a space stays with it; a space after other white
        space is no place to cut.
        """
        if "  " in text or any(c in text and c + " " in text for c in _SPACES):
            return _GAP.sub(_CUT, text)
        text = _LINE.sub(_CUT + "\n" + _CUT, text.replace(" ", _CUT + " "))
        return _MARK.sub("\0\\g<0>", text)

    def _at_spaces(self, text: str) -> str:
        """Cut at spaces and line ends, and between a letter and a mark; lower case first where that is safe.

        Up to U+024F lower case goes character by character, so it may come
        before the tokenizer's own normalisation, unless it makes an added token.
        """
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if text.isascii() or max(text) < "\u0250":
            low = text.lower()
            text = text if any(t in low for t in self.added) else low
        return _MARK.sub("\0\\g<0>", text.replace(" ", _CUT))

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(CACHE_CHUNKS, np.int64)
        self.sizes = np.zeros(CACHE_CHUNKS, np.int64)
        self.hits = np.zeros(CACHE_CHUNKS, np.int64)
        self.used = 0

    def _forget(self) -> None:
        """Keep the chunks that came most often, at most half of the cache."""
        n = len(self.index)
        least = 2
        while (self.hits[:n] >= least).sum() > CACHE_CHUNKS // 2:
            least *= 2
        keep = np.flatnonzero(self.hits[:n] >= least)
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.used = int(ends[-1]) if len(ends) else 0
        self.flat[:self.used] = self.flat[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(self.used)]
        self.starts[:len(keep)], self.sizes[:len(keep)] = ends - sizes, sizes
        self.hits[:] = 0

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each chunk)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, chunks: list[str]) -> None:
        flat, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.join is not None:
            # Many chunks in one call, the mark after each: no token spans it, and its id comes from nothing else.
            between, mark, end = self.join
            alone = [c for c in chunks if not c or mark in c or c in self.added
                     or c[-1].isspace() or (c[0] != " " and c[0].isspace())]
            apart = set(alone)
            easy = [c for c in chunks if c not in apart]
            joined, _ = self._encoded([between.join(easy[i:i + JOINED]) + between for i in range(0, len(easy), JOINED)])
            ends = np.flatnonzero(joined == end)
            if len(ends) == len(easy):
                flat, sizes = np.delete(joined, ends), np.diff(ends, prepend=-1) - 1
                chunks = easy + alone
            else:  # a vocabulary where other text has the mark's id
                self.join, alone = None, chunks
        else:
            alone = chunks
        more, counts = self._encoded(alone)
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, counts])
        n, total = len(self.index), int(sizes.sum())
        while n + len(chunks) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = flat
        self.starts[n:n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:n + len(chunks)] = sizes
        self.used += total
        self.index.update(zip(chunks, range(n, n + len(chunks))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); null counts as empty."""
        if len(self.index) > CACHE_CHUNKS:
            self._forget()
        if any(t and _CUT in t for t in texts):
            cut = [self._chunks(t) if t else [] for t in texts]
            places: dict[str, int] = {}
            which = pa.array([places.setdefault(c, len(places)) for part in cut for c in part], pa.int32())
            names, parts = list(places), list(map(len, cut))
        else:
            marked = [self._marked(t) if t else "" for t in texts]
            parts = [t.count(_CUT) for t in marked]
            raw = "".join(marked).encode()
            del marked
            names, which = _numbered(raw)
        found = list(map(self.index.get, names))
        new = [c for c, k in zip(names, found) if k is None]
        for i in range(0, len(new), LEARN_CHUNKS):
            self._learn(new[i:i + LEARN_CHUNKS])
        at = np.array([self.index[c] if k is None else k for c, k in zip(names, found)] if new else found, np.int64)
        self.hits[at] += np.bincount(which, minlength=len(names))
        # The ids of each different chunk as bytes, which Arrow lays out chunk by chunk.
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        own = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        every = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], 4 * ends])), pa.py_buffer(own)]).take(which)
        upto = np.frombuffer(every.buffers()[1], np.int64, len(which) + 1) // 4
        ids = np.frombuffer(every.buffers()[2] or b"", np.uint32, int(upto[-1]))
        bounds = np.cumsum([0, *parts])
        return ids, np.diff(upto[bounds])


def _numbered(raw: bytes) -> tuple[list[str], pa.Array]:
    """The different chunks of marked texts in UTF-8, and for each chunk the place of its like among them."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.frombuffer(raw, np.uint8) == ord(_CUT)) + 1])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    data, count = found.dictionary.buffers()[2], len(found.dictionary)
    return (data.to_pybytes().decode().split(_CUT)[:-1] if count else []), found.indices


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every text's ids; returns the ids and each text's offset (texts + 1)."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
