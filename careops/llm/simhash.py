"""SimHash near-duplicates, compared bit-sliced.

Fingerprints (64 bits) come from word shingles.  Two fingerprints within
``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit
blocks, so every choice of ``blocks - radius`` blocks is one table keyed by
those bits and no close pair is lost.  Inside a bucket the fingerprints are
stored as vertical bit planes: one 64-bit word holds the same bit of 64
members, and a carry-save counter adds one plane's differences to 64
distances at once.  Distances saturate above the radius and a row whose
whole word has passed it is abandoned.

Equal fingerprints are collapsed before anything is compared, so copies cost
nothing; a bucket is cut into bounded pairs of blocks; a group reports only a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.blocks import block_pairs, grouped
from careops.llm.common import byte_column, checkpoint, python_batches, slices, with_row
from careops.llm.components import components
from careops.llm.textscan import lower_ascii, word_spans

_U = np.uint64


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """One 64-bit fingerprint per text: the majority of its shingles' XXH64 bits."""
    starts, ends, first = word_spans(data, offsets)
    lens = ends - starts
    # All words, lower case, joined by single spaces: a shingle is a slice of it.
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    step = np.arange(lens.sum())
    before = np.concatenate([[0], np.cumsum(lens)])[:-1]
    joined[np.repeat(at[:-1] - before, lens) + step] = lower_ascii(data[np.repeat(starts - before, lens) + step])
    n_words = np.diff(first)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    text_of = np.repeat(np.arange(len(n_words)), n_shingles)
    base = np.concatenate([[0], np.cumsum(n_shingles)])
    word = first[:-1][text_of] + (np.arange(base[-1]) - base[:-1][text_of])
    last = np.minimum(word + shingle, first[1:][text_of])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[a:b], seed) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist())), _U, len(word))
    out = np.zeros(len(n_words), _U)
    full = np.flatnonzero(n_shingles)
    if len(full):
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> _U(bit)) & _U(1)).astype(np.int64), base[:-1][full])
            out[full] |= (2 * ones > n_shingles[full]).astype(_U) << _U(bit)
    return out


def _count_planes(query: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits tell which lanes lie within ``radius`` of each query.

    ``query``: fingerprints (n,); ``planes``: (64, n) or (64, 1, w) words of
    vertical bits, broadcast against the queries.  The distance counters are
    bit planes too; ``over`` marks lanes that have passed the radius.
    """
    shape = np.broadcast_shapes(query.shape, planes.shape[1:])
    width = max(1, int(radius).bit_length())
    live = np.arange(shape[0])
    over = np.zeros(shape, _U)
    counter = [np.zeros(shape, _U) for _ in range(width)]
    result = np.zeros(shape, _U)
    ones = ~_U(0)
    for bit in range(64):
        mask = np.where((query >> _U(bit)) & _U(1), ones, _U(0))
        carry = planes[bit] ^ mask
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if bit >= 3 and bit % 4 == 3:
            # Lanes whose counter exceeds the radius: compare with the constant, high bit first.
            above, equal = np.zeros_like(over), np.full_like(over, ones)
            for k in reversed(range(width)):
                if (radius >> k) & 1:
                    equal &= counter[k]
                else:
                    above |= equal & counter[k]
                    equal &= ~counter[k]
            over |= above
            dead = (over == ones).reshape(len(over), -1).all(axis=1)
            if bit < 63 and dead.mean() > 0.3:  # abandon blocks whose lanes have all passed the radius
                keep = ~dead
                live, over, query = live[keep], over[keep], query[keep]
                counter = [c[keep] for c in counter]
                if planes.shape[1] == len(keep):
                    planes = planes[:, keep]
                if not len(live):
                    break
    result[:] = 0
    result[live] = ~over
    return result


def _planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes of fingerprints: (64, words), 64 lanes a word."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, _U)
    padded[:len(values)] = values
    lanes = np.arange(64, dtype=_U)
    grid = padded.reshape(words, 64)
    return np.stack([np.bitwise_or.reduce(((grid >> _U(b)) & _U(1)) << lanes, axis=1) for b in range(64)])


def _unpack(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of every set bit of (n, w) words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little").reshape(len(words), -1)
    return np.nonzero(bits)


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of the same (contiguous) group within ``radius`` bits."""
    starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])
    sizes = np.diff(starts)
    left, right = [], []
    small = sizes <= 64
    if small.any():
        # Small groups: lay them out so that none crosses a 64-lane word.
        base = np.zeros(int(small.sum()), np.int64)
        room = 0
        for i, size in enumerate(sizes[small].tolist()):
            if room % 64 + size > 64:
                room += 64 - room % 64
            base[i] = room
            room += size
        rows = np.flatnonzero(np.repeat(small, sizes))
        lane = np.repeat(base, sizes[small]) + (rows - np.repeat(starts[:-1][small], sizes[small]))
        laid = np.zeros(-(-room // 64) * 64, _U)
        row_at = np.full(len(laid), -1)
        laid[lane], row_at[lane] = values[rows], rows
        planes = _planes(laid)
        for at in range(0, len(rows), 1 << 15):
            part, own = rows[at:at + (1 << 15)], lane[at:at + (1 << 15)]
            hit = _count_planes(values[part], planes[:, own // 64], radius)
            i, b = _unpack(hit[:, None])
            j = row_at[own[i] // 64 * 64 + b]
            i = part[i]
            fits = (j > i) & (groups[i] == groups[j])
            left.append(i[fits])
            right.append(j[fits])
    for g in np.flatnonzero(~small):
        lo, hi = starts[g], starts[g + 1]
        planes = _planes(values[lo:hi])[:, None, :]
        for at in range(lo, hi, 1024):
            part = values[at:min(at + 1024, hi)]
            hit = _count_planes(part[:, None], planes, radius)
            i, j = _unpack(hit)
            i, j = i + at, j + lo
            fits = (j < hi) & (j > i)
            left.append(i[fits])
            right.append(j[fits])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row index reachable from each of ``n`` rows over the given pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def simhash(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; null and empty texts get fingerprint zero, fewer words than a shingle hash whole."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                fp = fingerprints(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))],
                                                 names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp long")


def fingerprint_links(fps: DataFrame, radius: int, blocks: int = 6, block_rows: int = 4096) -> DataFrame:
    """Spanning links ``(u, v)`` among distinct fingerprints ``fp`` within ``radius`` bits.

    ``blocks`` bit blocks give C(blocks, radius) tables; any value above the
    radius loses no link, more blocks mean fewer members per bucket and more
    tables.  64 bits in 6 blocks and radius 4: 15 tables keyed by about 21 bits.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must be above the radius and at most 64")
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << int(edges[c + 1] - edges[c])) - 1) << int(edges[c]) for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.t", "b.k")
    pairs = block_pairs(rows, ["t", "k"], ["fp"], block_rows)
    group = ["t", "k", "lo", "hi"]

    def compare(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(_U)
        ids = np.zeros(len(values), np.int64)
        for c in group:
            col = table.column(c).to_numpy()
            ids[1:] |= col[1:] != col[:-1]
        left, right = close_pairs(values, np.cumsum(ids), radius)
        label = spanning(len(values), left, right)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": values[own].view(np.int64), "v": values[label[own]].view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, group, compare)

    return (pairs.select("fp", *group).repartition(*group).sortWithinPartitions(*group)
            .mapInArrow(run, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text", blocks: int = 6) -> DataFrame:
    """Class of near-duplicates of every row: ``(id, fingerprint, component_id)``.

    Lower-cases A-Z, shingles of ``shingle`` words; rows link when their
    fingerprints differ in at most ``radius`` bits; the component is the
    smallest id reachable.  Null, empty and word-less texts have fingerprint
    zero and are linked like any other.  Repeated rows stay; a null id takes
    part and never becomes a component while another id is there.  Very long
    texts are read whole.  An empty table gives no rows.  Other columns are ignored.
    """
    fps = checkpoint(simhash(docs, shingle, seed, id_col, text_col))
    lowest = _rooted(fps, radius, blocks)
    ids = lowest.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = lowest.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``(fp, least, root)`` per fingerprint of stored ``fps(id, fp)``: its smallest id and its group's root fingerprint."""
    classes = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(fingerprint_links(classes.select("fp"), radius, blocks))
    return classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, blocks: int = 6) -> DataFrame:
    """The documents that stay: exactly one row of each near-duplicate group.

    It is the row with the smallest doc_id (nulls last), then the smallest
    text hash; of rows equal in both, that with the smallest hash of all
    columns.  Null, empty and word-less texts form one group; texts of any
    length are read whole; an empty table gives no rows.  Columns are those of
    ``docs``, whatever their names.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    fps = checkpoint(simhash(docs.select(key.alias("key"), "text"), shingle, seed, "key"))
    first = _rooted(fps, radius, blocks).groupBy("root").agg(F.min("least").alias("k")).select(
        F.col("k.id").alias("first_id"), F.col("k.h").alias("first_h"))
    kept = with_row(docs, "doc_id", F.xxhash64("text").alias("h")).join(
        first, (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    equal = Window.partitionBy("doc_id", "h").orderBy(
        F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind]))
    return kept.withColumn("r", F.row_number().over(equal)).filter("r = 1").select("row.*")
