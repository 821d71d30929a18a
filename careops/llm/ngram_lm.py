"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Texts are read once: each batch of texts becomes one row with its distinct
word hashes and the words' local numbers, stored in a table bucketed by
batch.  From there on only packed arrays move:

* Word counts.  Each batch sends its distinct words, cut by hash range, to
  the ranges; a range adds up the training counts and answers every batch.
  A batch sends a word once however often it holds it, so no word is hot.
* Word pairs.  In the same way each batch sends its distinct pairs; a range
  adds up the training pairs and builds its segment of the filter: a pair
  seen c times is inserted as (pair, 1) ... (pair, q), q = 1 + floor(log2 c).
  For every asked pair it probes (pair, 1), (pair, 2), ... until one is
  missing and answers every batch with q.
* Scoring.  Each batch is joined to its answers (no shuffle of the stored
  side); only the model's constants are broadcast.

A pair is kept if it occurs at least ``min_count`` times, whatever the size
of the corpus: the filter's segments stay in their ranges.

The probability of word w after u mixes the pair and the word model.  With r
the share of training words after contexts as frequent as u (by powers of
two) whose pair is kept, and r' the share whose pair would be kept without
that very occurrence,

    P(w | u) = r'/r * count(u, w) / (count(u) + e) + (1 - r') * (c(w) + 1) / (N + V + 1)

count(u, w) is the mean count of the pairs with the same q, and e the mass
that false positives of the filter are expected to add, so that the
probabilities after u do not sum to more than one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.llm.blocks import grouped
from careops.llm.common import byte_column, id_remainder, python_batches, scratch_path, slices, stored
from careops.llm.textscan import Rolling, lower_ascii, mix, word_spans

_U = np.uint64
_KEEP = ~_U(0xFF)  # hashes of pairs travel as their upper 56 bits
END = int(mix(np.array([0x5EED], _U))[0])  # hash of the end token
BATCH_BYTES = 6 << 20
RANGE_ENTRIES = 2_000_000
BITS_PER_KEY = 14.4
PROBES = 10
LEVELS = 64


def shrink(values: np.ndarray) -> bytes:
    """Bytes of an array, byte planes together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def grow(body: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Range number of 64-bit hashes, ascending with them."""
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _encoded(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per batch of texts: batch, ids, held, sizes, vocab, words, seen, n_vocab, n_tokens."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                hashes, first = [], [np.zeros(1, np.int64)]
                for a, b in slices(offsets[i:j + 1], 1 << 21):
                    part = lower_ascii(data[offsets[i + a]:offsets[i + b]])
                    at = offsets[i + a:i + b + 1] - offsets[i + a]
                    starts, ends, begin = word_spans(part, at)
                    sizes = np.diff(begin) + 1
                    upto = np.cumsum(sizes)
                    tokens = np.full(int(upto[-1]), END, _U)
                    word = np.ones(len(tokens), bool)
                    word[upto - 1] = False
                    tokens[word] = Rolling(part).spans(starts, ends)
                    hashes.append(tokens)
                    first.append(sizes)
                tokens, sizes = np.concatenate(hashes), np.concatenate(first)[1:]
                held = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                vocab, back = np.unique(tokens, return_inverse=True)
                learn = np.repeat(~held, sizes)
                seen = np.bincount(back[learn], minlength=len(vocab))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                    pa.array([shrink(held)]), pa.array([shrink(sizes.astype(np.int32))]), pa.array([shrink(vocab)]),
                    pa.array([shrink(back.astype(np.uint32))]), pa.array([shrink(seen.astype(np.uint32))]),
                    pa.array([len(vocab)], pa.int64()), pa.array([len(tokens)], pa.int64())],
                    names=["batch", "ids", "held", "sizes", "vocab", "words", "seen", "n_vocab", "n_tokens"])
                number += 1

    schema = (f"batch long, ids array<{kind}>, held binary, sizes binary, vocab binary, words binary, seen binary, "
              "n_vocab long, n_tokens long")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~train).alias("held")).mapInArrow(run, schema)


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """Store ``df`` in the shared folder as a table bucketed by ``key``, so that joins on it do not move its rows."""
    spark = df.sparkSession
    name = f"lm_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, "lm-batches")).saveAsTable(name)
    return spark.table(name)


def _word_answers(batches: DataFrame, n: int) -> DataFrame:
    """(batch, range, counts, distinct, total): training counts of each batch's words, in hash order."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for number, vocab, seen in zip(*(row.column(c).to_pylist() for c in range(3))):
                vocab, seen = grow(vocab, _U), grow(seen, np.uint32)
                edges = np.searchsorted(_ranges(vocab, n), np.arange(n + 1))
                own = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(own), pa.int64()), pa.array(own, pa.int32()),
                    pa.array([shrink(vocab[edges[r]:edges[r + 1]]) for r in own], pa.binary()),
                    pa.array([shrink(seen[edges[r]:edges[r + 1]]) for r in own], pa.binary())],
                    names=["batch", "r", "vocab", "seen"])

    def answer(table: pa.Table) -> pa.Table:
        out = []
        ranges = table.column("r").to_numpy()
        for r in np.unique(ranges):
            own = table.filter(pa.array(ranges == r))
            words = [grow(x, _U) for x in own.column("vocab").to_pylist()]
            seen = np.concatenate([grow(x, np.uint32) for x in own.column("seen").to_pylist()])
            _, back = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(back, seen).astype(np.uint64)
            edges = np.cumsum([0, *map(len, words)])
            counts = [shrink(total[back[a:b]]) for a, b in zip(edges, edges[1:])]
            stats = [(int((total > 0).sum()), int(total.sum()))] + [(0, 0)] * (len(words) - 1)
            out.append(pa.table({"batch": own.column("batch"), "r": own.column("r"), "counts": pa.array(counts, pa.binary()),
                                 "distinct": [a for a, _ in stats], "total": [b for _, b in stats]}))
        return pa.concat_tables(out)

    asked = batches.select("batch", "vocab", "seen").mapInArrow(ask, "batch long, r int, vocab binary, seen binary")
    return asked.repartition("r").sortWithinPartitions("r", "batch").mapInArrow(
        lambda b: grouped(b, ["r"], answer, rows=1), "batch long, r int, counts binary, distinct long, total long")


def _contexts(words: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The word before each word; the end token stands before a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    begin = np.cumsum(sizes) - sizes
    before[begin] = end
    return before


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _U(0x9E3779B97F4A7C15) + (w ^ (w >> _U(29)))) & _KEEP


def _level(counts: np.ndarray) -> np.ndarray:
    """floor(log2) of positive counts."""
    return np.frexp(counts.astype(np.float64))[1] - 1


def _positions(keys: np.ndarray, level: int, bits) -> Iterator[np.ndarray]:
    h = mix(keys + _U(level * 0xA0761D6478BD642F % (1 << 64)))
    step = mix(h ^ _U(0xE7037ED1A0B428DB)) | _U(1)
    for k in range(PROBES):
        yield (h + _U(k) * step) % bits


def _segment(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Filter bytes, bits and number of (key, level) pairs for keys with q = levels."""
    inserted = int(levels.sum())
    bits = max(64, int(np.ceil(inserted * BITS_PER_KEY)))
    out = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, _U(bits)):
            out[at] = 1
    return np.packbits(out, bitorder="little"), bits, inserted


def _probe(pairs: np.ndarray, body: np.ndarray, bits: int) -> np.ndarray:
    """Level q that a segment holds for each pair, 0 for none."""
    level = np.zeros(len(pairs), np.uint8)
    live = np.arange(len(pairs))
    for q in range(1, LEVELS - 1):
        alive = np.arange(len(live))
        for at in _positions(pairs[live], q, _U(bits)):
            at = at[alive]
            byte = body[(at >> _U(3)).astype(np.int64)]
            alive = alive[((byte >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool)]
        live = live[alive]
        if not len(live):
            break
        level[live] = q
    return level


def _batch_pairs(vocab: np.ndarray, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pair hashes, ascending; a token of each; number of each token's pair)."""
    return np.unique(_pair_hash(vocab[before], vocab[words]), return_index=True, return_inverse=True)


def _pair_answers(batches: DataFrame, n: int, min_count: int) -> DataFrame:
    """(batch, range, levels, ...): the filter's level of each batch's pairs, in hash order.

    One row of each range also holds its segment's bits, bits set, and counts
    by context level and by pair level.
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for number, held, sizes, vocab, words, counts in zip(*(row.column(c).to_pylist() for c in range(6))):
                held, sizes = grow(held, bool), grow(sizes, np.int32).astype(np.int64)
                vocab, words, counts = grow(vocab, _U), grow(words, np.uint32), np.concatenate([grow(x, _U) for x in counts])
                before = _contexts(words, sizes, int(np.searchsorted(vocab, _U(END))))
                pairs, at, back = _batch_pairs(vocab, words, before)
                seen = np.bincount(back[np.repeat(~held, sizes)], minlength=len(pairs))
                level = _level(np.maximum(counts[before[at]], _U(1))).astype(np.uint8)
                edges = np.searchsorted(_ranges(pairs, n), np.arange(n + 1))
                own = np.flatnonzero(np.diff(edges))
                cut = [slice(edges[r], edges[r + 1]) for r in own]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(own), pa.int64()), pa.array(own, pa.int32()),
                    pa.array([shrink(pairs[c] >> _U(8)) for c in cut], pa.binary()),
                    pa.array([shrink(seen[c].astype(np.uint32)) for c in cut], pa.binary()),
                    pa.array([shrink(level[c]) for c in cut], pa.binary())], names=["batch", "r", "pairs", "seen", "level"])

    def answer(table: pa.Table) -> pa.Table:
        out = []
        ranges = table.column("r").to_numpy()
        for r in np.unique(ranges):
            own = table.filter(pa.array(ranges == r))
            asked = [grow(x, _U) << _U(8) for x in own.column("pairs").to_pylist()]
            edges = np.cumsum([0, *map(len, asked)])
            pairs, at, back = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
            seen = np.concatenate([grow(x, np.uint32) for x in own.column("seen").to_pylist()])
            level = np.concatenate([grow(x, np.uint8) for x in own.column("level").to_pylist()])[at]
            total = np.bincount(back, seen, len(pairs)).astype(np.int64)
            quantised = _level(total) + 1
            keep, alone = total >= min_count, total > min_count
            body, bits, _ = _segment(pairs[keep], quantised[keep])
            found = _probe(pairs, body, bits)
            stats = {"bits": bits, "filled": int(np.bitwise_count(body).sum()), "every": np.bincount(level, total, LEVELS),
                     "kept": np.bincount(level[keep], total[keep], LEVELS),
                     "alone": np.bincount(level[alone], total[alone], LEVELS),
                     "pairs": np.bincount(quantised[keep], minlength=LEVELS).astype(float),
                     "mass": np.bincount(quantised[keep], total[keep], LEVELS)}
            none = [None] * (len(asked) - 1)
            out.append(pa.table({
                "batch": own.column("batch"), "r": own.column("r"),
                "levels": pa.array([shrink(found[back[a:b]]) for a, b in zip(edges, edges[1:])], pa.binary()),
                **{name: pa.array([x, *none], pa.int64() if isinstance(x, int) else pa.list_(pa.float64()))
                   for name, x in stats.items()}}))
        return pa.concat_tables(out)

    asked = batches.select("batch", "held", "sizes", "vocab", "words", "counts").mapInArrow(
        ask, "batch long, r int, pairs binary, seen binary, level binary")
    out = "batch long, r int, levels binary, bits long, filled long, " + ", ".join(
        f"{c} array<double>" for c in ("every", "kept", "alone", "pairs", "mass"))
    return asked.repartition("r").sortWithinPartitions("r", "batch").mapInArrow(
        lambda b: grouped(b, ["r"], answer, rows=1), out)


class PairModel:
    """The model's few constants, of the same size for every corpus."""

    def __init__(self, answers: DataFrame, words: int, distinct: int, min_count: int):
        self.words, self.distinct, self.threshold = words, distinct, min_count
        names = ("every", "kept", "alone", "pairs", "mass")
        chosen = answers.filter(F.col("bits").isNotNull())
        bits, filled = chosen.agg(F.sum("bits"), F.sum("filled")).first()
        zipped = chosen.select(F.posexplode(F.arrays_zip(*names)).alias("at", "x")).groupBy("at").agg(
            *[F.sum(f"x.{c}").alias(c) for c in names]).collect()
        every, kept, alone, pairs, mass = (np.zeros(LEVELS) for _ in names)
        for row in zipped:
            every[row["at"]], kept[row["at"]], alone[row["at"]] = row.every, row.kept, row.alone
            pairs[row["at"]], mass[row["at"]] = row.pairs, row.mass
        # Contexts of a level without any training word follow the nearest lower one.
        self.share = kept / np.maximum(every, 1)
        self.alone = alone / np.maximum(every, 1)
        self.mean = mass / np.maximum(pairs, 1)
        self.lowest = 1 + int(np.log2(min_count))
        # A false pair must pass every probe of its lowest level and those below.
        fill = (filled or 0) / max(1, bits or 0)
        self.false_mass = distinct * fill ** (PROBES * self.lowest) * self.mean[self.lowest]

    def counts(self, levels: np.ndarray) -> np.ndarray:
        """Mean training count of each level, 0 for pairs that are not held."""
        return np.where(levels >= self.lowest, self.mean[levels], 0.0)

    def log_probability(self, levels, counts, before, words) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the word model, log10 of the pair model) for each word; ``levels`` are those of its pair."""
        base = (counts + 1.0) / (self.words + self.distinct + 1.0)
        cu, cw = counts[before], counts[words]
        # A kept pair needs both its words at least as often.
        may = np.flatnonzero((cu >= self.threshold) & (cw >= self.threshold))
        pair = np.zeros(len(words))
        pair[may] = np.minimum(self.counts(levels[may]), np.minimum(cu[may], cw[may]))
        level = _level(np.maximum(cu, 1))
        share, alone = self.share[level], self.alone[level]
        ratio = np.where(share > 0, alone / np.where(share > 0, share, 1), 0)
        mixed = ratio * pair / np.maximum(cu + self.false_mass, 1) + (1 - alone) * base[words]
        # A context whose pairs are all kept leaves nothing to others: the word model at the smallest share.
        return np.log10(base)[words], np.log10(np.maximum(mixed, base[words] * 1e-3))


def score_texts(docs: DataFrame, train: Column | None = None, min_count: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that ``train`` picks (all by default) and scores every
    row, whole texts: lower-cased words and one end token.  Null and empty
    texts are the end token alone.  With nothing to learn from, both scores
    are 0 for every token.  Repeated rows count each time; null ids pass
    through; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    python_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    batches = _bucketed(_encoded(docs, train, id_col, text_col), "batch")
    size = batches.agg(F.sum("n_vocab"), F.sum("n_tokens")).first()
    n_words = max(1, -(-(size[0] or 0) // RANGE_ENTRIES))
    n_pairs = max(1, -(-(size[1] or 0) // RANGE_ENTRIES))
    answers = stored(_word_answers(batches, n_words), "lm-answers")
    stats = answers.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = stats[0] or 0, stats[1] or 0
    per_batch = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("r", "counts"))).alias("a")).select(
        "batch", F.col("a.counts").alias("counts"))
    known = batches.join(per_batch.hint("merge"), "batch")
    pair_answers = stored(_pair_answers(known, n_pairs, min_count), "lm-pairs")
    held_model = spark.sparkContext.broadcast(PairModel(pair_answers, total, distinct, min_count))
    per_batch = pair_answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("r", "levels"))).alias("a")).select(
        "batch", F.col("a.levels").alias("levels"))
    known = known.join(per_batch.hint("merge"), "batch")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model.value
        for row in rows:
            for i in range(row.num_rows):
                ids = row.column(0).slice(i, 1).flatten()
                held, sizes, vocab, words, counts, levels = (row.column(c)[i].as_py() for c in range(1, 7))
                held, sizes = grow(held, bool), grow(sizes, np.int32).astype(np.int64)
                vocab, words = grow(vocab, _U), grow(words, np.uint32).astype(np.int64)
                counts = np.concatenate([grow(x, _U) for x in counts]).astype(np.float64)
                before = _contexts(words, sizes, int(np.searchsorted(vocab, _U(END))))
                _, _, back = _batch_pairs(vocab, words, before)
                levels = np.concatenate([grow(x, np.uint8) for x in levels])[back]
                base, pair = model.log_probability(levels, counts, before, words)
                begin = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(held), pa.array(sizes), pa.array(np.add.reduceat((counts[words] > 0).astype(np.int64), begin)),
                    pa.array(np.full(len(sizes), model.words, np.int64)),
                    pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(pair, begin))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.select("ids", "held", "sizes", "vocab", "words", "counts", "levels").mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("id", id_col)


def train_split() -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 7 is not 2."""
    return id_remainder("doc_id", 7) != 2
