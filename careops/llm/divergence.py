"""How the sources of a language differ in their words, by an exact recount through perfect hashes.

1. *Filter.*  The number of documents of every (language, term), exactly; the
   terms of at least ``min_docs`` documents stay.
2. *Perfect hashes.*  Each language's terms are dealt to shards of bounded
   size by hash, and every shard becomes a minimal perfect hash that stores
   its keys.
3. *Recount.*  A second pass over the texts looks every term up, compares the
   stored key, and increments a dense array of slots for each (language,
   source).  Shards are broadcast where all of them together stay below a
   stated number of bytes; beyond it the terms are counted for each batch
   and sent to the shards, by partition, with the same shards and the same
   dense slots.
4. *Divergence.*  Per thousand million, smoothed shares ``p`` of every term
   in every source, and from them the squared differences over sums between
   sources (``pair``) and of a source against its language (``term``).

All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.blocks import grouped
from careops.llm.common import byte_column, python_batches, stored
from careops.llm.perfect_hash import PerfectHash

# Bytes of a term: ASCII letters (in lower case) and everything beyond ASCII; all others become spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 13
HELD_TERMS = 400_000  # distinct terms that a task of a pass over the texts holds before it hands them on
HELD_SLOTS = 8 << 20  # slots of dense arrays that a task of the recount holds
MERGED_TASKS = 1024  # tasks of the recount whose counts are added up first
BROADCAST_BYTES = 32 << 20
SOURCE_BLOCK = 256
PIECE_SLOTS = 4096
TEXT_PART = 1 << 22


def term_hash(terms: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each term, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """A term's shard in its language, from the upper half of its hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def shard_column(term: Column, shards: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(term), 32) % shards).cast("int")


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size (a term is never cut)."""
    low = text.translate(LETTERS)
    at = 0
    while len(low) - at > TEXT_PART:
        end = low.find(b" ", at + TEXT_PART)
        if end < 0:
            break
        yield low[at:end].split()
        at = end
    yield low[at:].split()


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = byte_column(batch.column(column))
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(raw[a:b])


def _rows(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many texts of its language each term occurs, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                terms = list(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                counts = held.setdefault(lang, Counter())
                size -= len(counts)
                own: set[bytes] = set()
                for terms in text_terms(text):
                    own.update(terms)
                counts.update(own)
                size += len(counts)
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    return parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def kept_terms(rows: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` texts of their language."""
    return document_frequencies(rows).filter(F.col("docs") >= min_docs).select("lang", "term")


def hash_shards(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shard, shards, n, body): a perfect hash for each shard of a language's terms."""

    def build(table: pa.Table) -> pa.Table | None:
        bodies, langs, shards, counts, sizes = [], [], [], [], []
        lang, shard = table.column("lang").to_pylist(), table.column("shard").to_pylist()
        terms, many = table.column("term").to_pylist(), table.column("shards").to_pylist()
        edges = [0, *[i for i in range(1, len(lang)) if (lang[i], shard[i]) != (lang[i - 1], shard[i - 1])], len(lang)]
        for a, b in zip(edges, edges[1:]):
            some = terms[a:b]
            bodies.append(PerfectHash.build(some, term_hash(some)).dump())
            langs.append(lang[a])
            shards.append(shard[a])
            counts.append(many[a])
            sizes.append(b - a)
        return pa.table({"lang": pa.array(langs, pa.string()), "shard": pa.array(shards, pa.int32()),
                         "shards": pa.array(counts, pa.int32()), "n": pa.array(sizes, pa.int32()),
                         "body": pa.array(bodies, pa.binary())})

    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).cast("int").alias("shards"))
    dealt = kept.join(sizes, "lang").select("lang", shard_column(F.col("term"), F.col("shards")).alias("shard"),
                                            "shards", "term")
    ordered = dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term")
    return ordered.mapInArrow(lambda b: grouped(b, ["lang", "shard"], build, rows=shard_terms),
                              "lang string, shard int, shards int, n int, body binary")


def shard_keys(shards: DataFrame) -> DataFrame:
    """(lang, shard, slot, item): the stored keys by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, shard, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = PerfectHash.load(body).keys
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys), pa.string()), pa.array([shard] * len(keys), pa.int32()),
                    pa.array(range(len(keys)), pa.int32()), pa.array(keys, pa.binary()).cast(pa.string())],
                    names=["lang", "shard", "slot", "item"])

    return shards.select("lang", "shard", "body").mapInArrow(run, "lang string, shard int, slot int, item string")


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[str, str, Counter]]:
    """Term counts of each (language, source) of a batch, in parts of bounded size."""
    held: dict[tuple[str, str], Counter] = {}
    size = 0
    for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2)):
        counts = held.setdefault((lang, source), Counter())
        for terms in text_terms(text):
            size -= len(counts)
            counts.update(terms)
            size += len(counts)
            if size > HELD_TERMS:
                yield from ((*k, c) for k, c in held.items())
                held, size = {(lang, source): (counts := Counter())}, 0
    yield from ((*k, c) for k, c in held.items())


class _Slots:
    """Dense counts of every (language, source, shard) that a task has met, handed on as (slots, counts) rows."""

    def __init__(self):
        from pyspark import TaskContext

        self.used, self.held = 0, {}
        self.salt = TaskContext.get().partitionId() // MERGED_TASKS

    def of(self, lang: str, source: str, shard: int, size: int) -> np.ndarray:
        key = (lang, source, shard)
        if key not in self.held:
            self.held[key] = np.zeros(size, np.int64)
            self.used += size
        return self.held[key]

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """Everything held, once it is more than ``least`` slots."""
        if self.used <= least or not self.held:
            return
        for (lang, source, shard), counts in self.held.items():
            yield _part(lang, source, shard, self.salt, counts)
        self.held, self.used = {}, 0


_SLOTS = "lang string, source string, shard int, salt int, size int, slots binary, counts binary"


def _part(lang: str, source: str, shard: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    slots = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([
        pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([shard], pa.int32()),
        pa.array([salt], pa.int32()), pa.array([len(counts)], pa.int32()),
        pa.array([slots.astype("<u4").tobytes()], pa.binary()),
        pa.array([counts[slots].astype("<i8").tobytes()], pa.binary())],
        names=["lang", "source", "shard", "salt", "size", "slots", "counts"])


class _Places:
    """Slots of a language's terms, looked up in its perfect hashes once while a bounded cache holds them."""

    def __init__(self, shards: int):
        self.shards, self.hashes = shards, {}
        self.known: dict[bytes, int] = {}

    def put(self, shard: int, body: bytes) -> None:
        self.hashes[shard] = PerfectHash.load(body)

    def ready(self) -> None:
        """Shards lie end to end: a term's place is its shard's first place and its slot."""
        sizes = [len(self.hashes.get(s, ())) for s in range(self.shards)]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def of(self, terms: list[bytes]) -> np.ndarray:
        """The place of each term, -1 for one that is not kept."""
        out = np.fromiter(map(self.known.get, terms, repeat(-2)), np.int64, len(terms))
        missing = np.flatnonzero(out == -2)
        if len(missing):
            if len(self.known) > HELD_TERMS:
                self.known = {}
            asked = [terms[i] for i in missing.tolist()]
            new = list(set(asked))
            self.known.update(zip(new, self._look(new).tolist()))
            out[missing] = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        return out

    def _look(self, terms: list[bytes]) -> np.ndarray:
        codes = term_hash(terms)
        shard, out = shard_of(codes, self.shards), np.full(len(terms), -1, np.int64)
        for s, own in self.hashes.items():
            mine = np.flatnonzero(shard == s)
            at = own.slots([terms[i] for i in mine.tolist()], codes[mine])
            out[mine] = np.where(at >= 0, at + self.first[s], -1)
        return out


def _broadcast_recount(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Partial dense counts with every shard broadcast; the caller has checked their bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(
        [tuple(r) for r in shards.select("lang", "shard", "shards", "body").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, _Places] = {}
        for lang, shard, number, body in sent.value:
            places.setdefault(lang, _Places(number)).put(shard, bytes(body))
        for own in places.values():
            own.ready()
        slots = _Slots()
        for batch in batches:
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2)):
                if lang in places:
                    texts.setdefault((lang, source), []).append(text)
            for (lang, source), some in texts.items():
                own = places[lang]
                for terms in text_terms(b"\n".join(some)):  # a line end is part of no term
                    at = own.of(terms)
                    at, times = np.unique(at[at >= 0], return_counts=True)
                    edges = np.searchsorted(at, own.first)
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        part = slice(edges[s], edges[s + 1])
                        size = int(own.first[s + 1] - own.first[s])
                        slots.of(lang, source, s, size)[at[part] - own.first[s]] += times[part]
                yield from slots.flush(HELD_SLOTS)
        yield from slots.flush()

    return rows.mapInArrow(run, _SLOTS)


def _sent_recount(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """The same counts where the shards are too large to broadcast: batch counts of terms go to their shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, counts in _counted(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()),
                    pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "source", "term", "n"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, own, here = _Slots(), None, None
        for batch in batches:
            lang, shard = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            source, terms = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            times = batch.column(4).to_numpy()
            edges = [0, *[i for i in range(1, len(lang)) if (lang[i], shard[i], source[i]) != (
                lang[i - 1], shard[i - 1], source[i - 1])], len(lang)]
            for a, b in zip(edges, edges[1:]):
                if source[a] is None:  # the shard itself comes before its terms
                    own, here = PerfectHash.load(terms[a]), (lang[a], shard[a])
                    continue
                if here != (lang[a], shard[a]):
                    continue  # no kept term has this hash
                at = own.slots(terms[a:b], term_hash(terms[a:b]))
                hit = at >= 0
                np.add.at(slots.of(lang[a], source[a], shard[a], len(own)), at[hit], times[a:b][hit])
                yield from slots.flush(HELD_SLOTS)
        yield from slots.flush()

    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long")
    many = shards.groupBy("lang").agg(F.max("shards").alias("shards"))
    asked = parts.join(many, "lang").select(
        "lang", shard_column(F.col("term"), F.col("shards")).alias("shard"), "source", "term", "n")
    both = asked.union(shards.select("lang", "shard", F.lit(None).cast("string"), "body", F.lit(0).cast("long")))
    return both.repartition("lang", "shard").sortWithinPartitions(
        "lang", "shard", F.col("source").asc_nulls_first()).mapInArrow(probe, _SLOTS)


def _merged(parts: DataFrame, last: bool) -> DataFrame:
    """Partial counts of the same (language, source, shard) added up, one dense array at a time.

    The first round adds up what ``MERGED_TASKS`` tasks sent, the last one
    the sums of those, so that no task reads more than so many rows of a key
    however hot a source is.
    """
    keys = ["lang", "source", "shard", *([] if last else ["salt"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, salt, total = None, 0, None

        def out() -> pa.RecordBatch:
            if not last:
                return _part(*key[:3], salt, total)
            slots = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(slots), pa.string()), pa.array([key[1]] * len(slots), pa.string()),
                pa.array([key[2]] * len(slots), pa.int32()), pa.array(slots, pa.int32()), pa.array(total[slots])],
                names=["lang", "source", "shard", "slot", "n"])

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("lang", "source", "shard", "salt", "size")}
            for i, now in enumerate(zip(*(columns[k] for k in keys))):
                if now != key:
                    if key is not None:
                        yield out()
                    key, salt, total = now, columns["salt"][i], np.zeros(columns["size"][i], np.int64)
                at = np.frombuffer(batch.column("slots")[i].as_buffer(), "<u4")
                total[at] += np.frombuffer(batch.column("counts")[i].as_buffer(), "<i8")
        if key is not None:
            yield out()

    schema = "lang string, source string, shard int, slot int, n long" if last else _SLOTS
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def recount(rows: DataFrame, shards: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, shard, slot, n): how often each kept term occurs in each source, where it does."""
    size = shards.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("b")).first()["b"]
    parts = _broadcast_recount(rows, shards) if size <= broadcast_bytes else _sent_recount(rows, shards)
    return _merged(_merged(parts, False), True)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two non-negative longs, 0 for a divisor of 0."""
    return F.call_function("div", a, F.greatest(b, F.lit(1)))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), three digits at a time (10^9 = 1000^3), without overflow."""
    by = total + 2 * terms
    digits, rest = F.lit(0).cast("long"), (count + 2).cast("long")
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + _div(rest, by), rest % F.greatest(by, F.lit(1))
    return digits + 1


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def group_sizes(rows: DataFrame, counts: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, gi, n, v, lang_n, p0) of every (language, source), with terms or without.

    ``gi`` numbers a language's sources, ``n`` counts kept terms there and
    ``lang_n`` in the language, ``v`` is the number of kept terms and ``p0``
    the share of a term that the source lacks.
    """
    every = rows.select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = shards.groupBy("lang").agg(F.sum("n").cast("long").alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    by_lang = Window.partitionBy("lang")
    known = every.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", zero("n"), zero("v"))
    return known.select(
        "lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("gi"), "n", "v",
        F.sum("n").over(by_lang).alias("lang_n"),
        share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("p0"))


def pair_sums(counts: DataFrame, groups: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, a, b, value, present): summed differences of the sources a < b over terms that occur near them.

    The terms of a language are cut into pieces and its sources into blocks;
    a task holds the shares of two blocks over one piece as a dense matrix.
    ``present`` counts the terms that were summed up; all others have the
    sources' ``p0``.
    """
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "gi", "shard", F.floor(F.col("slot") / PIECE_SLOTS).cast("int").alias("piece"), "slot",
        share(F.col("counted"), F.col("n"), F.col("v")).alias("p"))
    # Every source of the language is laid beside every piece, so that a task knows the sources that lack its terms.
    pieces = shards.select("lang", "shard", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n") - 1) / PIECE_SLOTS).cast("int"))).alias("piece"))
    lacking = groups.join(pieces, "lang").select(
        "lang", "gi", "shard", "piece", F.lit(-1).alias("slot"), F.col("p0").alias("p"))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("gi") / SOURCE_BLOCK).cast("int").alias("last"))
    own = F.floor(F.col("gi") / SOURCE_BLOCK).cast("int")
    laid = shares.union(lacking).join(blocks, "lang").select(
        "*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    keys = ["lang", "lo", "hi", "shard", "piece"]
    laid = laid.select("lang", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                       "shard", "piece", "gi", "slot", "p")

    def one(lang: str, lo: int, hi: int, gi: np.ndarray, slot: np.ndarray, p: np.ndarray) -> pa.Table | None:
        real = slot >= 0
        if not real.any():
            return None
        order = np.argsort(gi[~real])
        names, base = gi[~real][order], p[~real][order]
        slots, column = np.unique(slot[real], return_inverse=True)
        matrix = np.repeat(base[:, None], len(slots), axis=1)
        matrix[np.searchsorted(names, gi[real]), column] = p[real]
        block = names // SOURCE_BLOCK
        left, right, value = [], [], []
        for i in np.flatnonzero(block == lo).tolist():
            others = np.arange(i + 1, len(names)) if lo == hi else np.flatnonzero(block == hi)
            for some in np.array_split(others, max(1, len(others) // 64)):
                gap = matrix[some] - matrix[i]
                value.append((gap * gap // (matrix[some] + matrix[i])).sum(axis=1))
                left.append(np.full(len(some), names[i]))
                right.append(names[some])
        a, b, total = np.concatenate(left), np.concatenate(right), np.concatenate(value)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()),
                         "b": pa.array(b, pa.int32()), "value": pa.array(total, pa.int64()),
                         "present": pa.array(np.full(len(a), len(slots)), pa.int64())})

    def handle(table: pa.Table) -> pa.Table | None:
        key = list(zip(*(table.column(k).to_pylist() for k in keys)))
        edges = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        gi, slot, p = (table.column(c).to_numpy() for c in ("gi", "slot", "p"))
        found = [t for a, b in zip(edges, edges[1:]) if (t := one(*key[a][:3], gi[a:b], slot[a:b], p[a:b])) is not None]
        return pa.concat_tables(found) if found else None

    parts = laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        lambda b: grouped(b, keys, handle), "lang string, a int, b int, value long, present long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang",
                      source_col: str = "source", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
                      shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    ``pair``: the other sources of the language by their summed difference,
    all of them; ``term``: the ``top`` kept terms that the source has more of
    than its language, by difference.  Ranks start at 1, by falling value and
    then by item.  Null languages, sources and texts count as empty; a source
    without kept terms has its pairs; texts of any length are read whole;
    repeated rows count each; an empty table gives no rows; other columns are
    ignored, whatever their names.  Kept terms are an exact filter over all
    rows.  The shards are broadcast if they take at most ``broadcast_bytes``.
    """
    python_batches(docs.sparkSession)
    rows = _rows(docs, lang_col, source_col, text_col)
    kept = stored(kept_terms(rows, min_docs), "kept-terms")
    shards = stored(hash_shards(kept, shard_terms), "term-shards")
    counts = stored(recount(rows, shards, broadcast_bytes), "term-counts")
    groups = stored(group_sizes(rows, counts, shards), "term-groups")
    counted = counts.withColumnRenamed("n", "counted")

    q = F.sum("counted").over(Window.partitionBy("lang", "shard", "slot"))
    in_source = counted.withColumn("total", q).join(groups, ["lang", "source"]).select(
        "lang", "source", "shard", "slot", share(F.col("counted"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")).filter("p > q")
    terms = in_source.join(shard_keys(shards), ["lang", "shard", "slot"]).select(
        "lang", "source", F.lit("term").alias("part"), "item", difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    sums = pair_sums(counted, groups, shards)
    other = groups.select("lang", F.col("source").alias("item"), F.col("gi").alias("gj"), F.col("p0").alias("q0"))
    both = groups.join(other, "lang").filter("gi <> gj").withColumn("a", F.least("gi", "gj")).withColumn(
        "b", F.greatest("gi", "gj"))
    zero = F.lit(0).cast("long")
    pairs = both.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.coalesce("value", zero) + (F.col("v") - F.coalesce("present", zero))
         * difference(F.col("p0"), F.col("q0"))).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(best)
