"""Removal of long repeated byte strings with suffix order and previous-factor matches.

A string of ``length`` bytes is repeated if it also starts somewhere else.
Sorting every suffix of a corpus would move each byte many times; instead:

1. Anchors.  Every window of ``length`` bytes names the smallest hashed gram
   inside it.  Equal windows name equal grams at equal distances, so suffixes
   that share ``length`` bytes always meet under one gram, and an unshared
   gram cannot start a repeat.  Neighbouring windows share their anchor: a
   segment is a run of window starts with one anchor.
2. Equal segments are combined before the shuffle (a weight and the first
   place), so copies of whole passages cost one row however many there are.
3. Suffix order.  The suffixes of all segments of an anchor are sorted by
   induction: segments are sorted by what follows the anchor, and the order
   of the suffixes one byte longer is the stable sort of the present order by
   the byte before.
4. Longest previous factors.  In that order the earlier suffix that shares
   most with a suffix is the previous one with a smaller text position or the
   next one.  Both are found by following links, and the least common prefix
   on the way is the length of the match; the larger of the two is the
   longest-previous-factor value.  A window is a later copy where its value
   reaches ``length``.  The same array over falling positions gives the
   matches with later places, for ``keep="none"``.
5. The matched windows of a segment hold for all its occurrences.

An anchor with more than ``group`` different segments is not sorted in one
task: its windows are compared by 128-bit digests, combined before their
shuffle, which gives the same classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from careops.functions.ordering import row_number_within
from careops.llm.blocks import grouped
from careops.llm.common import byte_column, python_batches, slices, stored, with_row, with_text
from careops.llm.textscan import Rolling

GRAM = 64
GROUP_SEGMENTS = 16384
# What a Python worker holds beside its batch: two workers share an executor's rest with what the JVM keeps off its heap.
BATCH_BYTES = 2 << 20  # of an Arrow batch
SLICE_BYTES = 1 << 18  # of the texts scanned at a time: some twenty arrays of eight bytes a byte
TABLE_SEGMENTS = 4096  # sorted at a time, unless one anchor has more
ROW_SEGMENTS = 1024  # laid out at a time
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_PLACE = np.uint64((1 << 28) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Segments of a buffer of texts: (text, lo, span, rel, key, digest, times) arrays.

    ``lo`` is the first window start in its text, ``span`` the last one's
    distance from it, ``rel`` the anchor's; ``key`` hashes the gram at the
    anchor and ``digest`` all bytes of the segment's windows.  Where a text
    repeats itself at once (one word or line again and again) equal segments
    follow each other every span + 1 bytes; they come once, with their number.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    rolling = Rolling(data)
    hashes = rolling.grams(gram)
    width = length - gram + 1
    order = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(order) // width) * width, ~np.uint64(0))
    padded[:len(order)] = order
    rows = padded.reshape(-1, width)
    count = n - length + 1
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:count], ahead[width - 1:width - 1 + count]) & _PLACE).astype(np.int64)
    edge = np.zeros(count + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    joined = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(valid & ~np.concatenate([joined, [False]]))
    text = np.searchsorted(offsets, first, "right") - 1
    key = hashes[at[first]].view(np.int64)
    digest = Rolling(data, _SECOND_BASE).spans(first, last + length).view(np.int64)
    span = last - first
    again = np.zeros(len(first), bool)
    again[1:] = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & (
        first[1:] == first[:-1] + span[:-1] + 1)
    own = np.flatnonzero(~again)
    times = np.diff(np.append(own, len(first)))
    return (text[own], first[own] - offsets[text[own]], span[own], at[first[own]] - first[own], key[own], digest[own],
            times)


def _smaller_before(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the previous one in suffix order whose place is smaller (0: none)."""
    link = np.arange(-1, len(place) - 1)
    shared = lcp.copy()
    # All between link[i] and i have larger places than i; shared[i] is the least common prefix on the way.
    todo = np.flatnonzero(shared > 0)
    while len(todo):
        todo = todo[place[link[todo]] > place[todo]]
        via = link[todo]
        least, further = np.minimum(shared[todo], shared[via]), link[via]
        shared[todo], link[todo] = least, further
        todo = todo[least > 0]
    return shared


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor values of suffixes given in suffix order.

    ``place`` holds their text positions, all different; ``lcp[i]`` the common
    prefix of suffixes i - 1 and i, ``lcp[0]`` being 0.
    """
    before = _smaller_before(place, lcp)
    after = _smaller_before(place[::-1], np.append(lcp[:1], lcp[:0:-1]))[::-1]
    return np.maximum(before, after)


def _range_minima(values: np.ndarray) -> np.ndarray:
    """Row k, column i: least of values[i : i + 2**k]."""
    rows, step = [values], 1
    while 2 * step <= len(values):
        wider = rows[-1].copy()
        wider[:-step] = np.minimum(wider[:-step], rows[-1][step:])
        rows.append(wider)
        step *= 2
    return np.stack(rows)


def _least(minima: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    k = np.frexp(end - first)[1] - 1
    return np.minimum(minima[k, first], minima[k, end - (1 << k)])


def suffix_matches(group: np.ndarray, bodies: np.ndarray, begin: np.ndarray, rel: np.ndarray, span: np.ndarray,
                   weight: np.ndarray, place: np.ndarray, length: int, gram: int, keep_first: bool) -> np.ndarray:
    """Matched window starts of each segment: boolean (segments, length - gram + 1), column = start - lo.

    ``group`` ascends; ``place`` ranks the segments' anchors in text order.
    """
    m = len(group)
    steps = length - gram + 1
    least = rel - span  # distances of the anchor from the windows: least .. rel
    column = np.arange(length)
    right = np.zeros((m, length + 4), np.uint8)
    right[:, :4] = group.astype(">u4").view(np.uint8).reshape(m, 4)
    for i in range(0, m, ROW_SEGMENTS):
        at = slice(i, i + ROW_SEGMENTS)
        known = column < (length - least[at])[:, None]
        source = np.where(known, (begin + rel)[at, None] + column, 0)
        right[at, 4:] = np.where(known, bodies[source], 0)
    order = np.argsort(right.view(f"S{length + 4}").ravel(), kind="stable")
    sorted_right = right[order]
    differs = sorted_right[1:] != sorted_right[:-1]
    common = _range_minima(np.where(differs.any(axis=1), differs.argmax(axis=1) - 4, length))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    left = group.astype(np.int64)  # class of the bytes between window start and anchor
    matched = np.zeros((m, steps), bool)
    for d in range(steps):
        if d:
            alive = order[rel[order] >= d]
            if not len(alive):
                break
            byte = bodies[begin[alive] + rel[alive] - d]
            turn = np.argsort(group[alive] * 256 + byte, kind="stable")
            order, byte = alive[turn], byte[turn]
            fresh = np.ones(len(order), np.int64)
            old = left[order]
            fresh[1:] = (old[1:] != old[:-1]) | (byte[1:] != byte[:-1])
            left[order] = np.cumsum(fresh)
        now = order[least[order] <= d]
        if not len(now):
            continue
        # Neighbours share d bytes and what follows the anchor, or end before the anchor: that counts as nothing.
        lcp = np.zeros(len(now), np.int64)
        same = np.flatnonzero(left[now[1:]] == left[now[:-1]])
        lcp[same + 1] = np.minimum(_least(common, rank[now[same]], rank[now[same + 1]]) + d, length)
        hit = previous_factors(place[now], lcp) >= length
        if not keep_first:
            hit |= (previous_factors(-place[now], lcp) >= length) | (weight[now] > 1)
        rows = now[hit]
        matched[rows, rel[rows] - d] = True
    return matched


def _runs(matched: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    wide = np.zeros((matched.shape[0], matched.shape[1] + 2), np.int8)
    wide[:, 1:-1] = matched
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _text_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _all_segments(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                text, lo, span, rel, key, digest, times = segments(
                    data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length, gram)
                take = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(2).take(take), pa.array(key), pa.array(digest),
                    pa.array(lo, pa.int32()), pa.array(span, pa.int16()), pa.array(rel, pa.int16()),
                    pa.array(times, pa.int32())], names=["id", "h", "key", "digest", "lo", "span", "rel", "times"])

    kind = dict(keyed.dtypes)["id"]
    return keyed.select("id", "text", "h").mapInArrow(
        run, f"id {kind}, h long, key long, digest long, lo int, span short, rel short, times int")


def _bodies(keyed: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The bytes of each segment, read from the text of its first occurrence."""
    lists = firsts.groupBy("id", "h").agg(F.collect_list(
        F.struct("key", "digest", "weight", "distinct", "lo", "span", "rel")).alias("parts"))
    joined = keyed.join(lists.withColumnRenamed("h", "h2").withColumnRenamed("id", "id2"),
                        (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2"))).select(
        "id", "h", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3)
            owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
            flat = parts.flatten()
            field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            _, offsets = byte_column(batch.column(2))
            lo, span = field["lo"].to_numpy(), field["span"].to_numpy()
            texts = batch.column(2).to_pylist()
            end = lo.astype(np.int64) + span + length
            body = [texts[o][a:b] for o, a, b in zip(owner.tolist(), lo.tolist(), end.tolist())]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *field.values(), pa.array(body, pa.binary())],
                names=["id", "h", *field, "body"])

    kind = dict(keyed.dtypes)["id"]
    return joined.mapInArrow(run, f"id {kind}, h long, key long, digest long, weight long, distinct long, "
                                  "lo int, span short, rel short, body binary")


def _sorted_matches(bodies: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """Matched byte ranges (key, digest, s, e) of segments, relative to their first byte, by suffix order."""

    def handle(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        data, offsets = byte_column(table.column("body").combine_chunks())
        ids = table.column("id").combine_chunks()
        ranks = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)
        lo, rel = table.column("lo").to_numpy().astype(np.int64), table.column("rel").to_numpy().astype(np.int64)
        place = np.empty(len(keys), np.int64)
        place[np.lexsort((lo + rel, table.column("h").to_numpy(), ranks))] = np.arange(len(keys))
        digest = table.column("digest").to_numpy()
        again = np.zeros(len(keys), bool)  # a repeated row brings its segments again
        by = np.lexsort((digest, group))
        again[by[1:]] = (digest[by[1:]] == digest[by[:-1]]) & (group[by[1:]] == group[by[:-1]])
        own = np.flatnonzero(~again)
        matched = suffix_matches(
            group[own], data, offsets[:-1][own], rel[own], table.column("span").to_numpy().astype(np.int64)[own],
            table.column("weight").to_numpy()[own], place[own], length, gram, keep_first)
        row, first, last = _runs(matched)
        row = own[row]
        return pa.table({"key": keys[row], "digest": digest[row], "s": first, "e": last + length})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole batches would make tables of as many segments as fit in one more.
        parts = (b.slice(i, TABLE_SEGMENTS) for b in batches for i in range(0, b.num_rows, TABLE_SEGMENTS))
        return grouped(parts, ["key"], handle, rows=TABLE_SEGMENTS)

    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, digest long, s long, e long")


def _counted_matches(bodies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same ranges for anchors with very many different segments: windows compared by digests."""
    kind = dict(bodies.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("body"))
            spans = batch.column("span").to_numpy().astype(np.int64)
            for i, j in slices(offsets, SLICE_BYTES):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                owner = np.repeat(np.arange(i, j), spans[i:j] + 1)
                s = np.arange(len(owner)) - np.repeat(np.cumsum(spans[i:j] + 1) - spans[i:j] - 1, spans[i:j] + 1)
                begin = at[owner - i] + s
                take = pa.array(owner)
                w1, w2 = (Rolling(part, b).spans(begin, begin + length).view(np.int64)
                          for b in (0x9E3779B97F4A7C15, _SECOND_BASE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in ("id", "h", "key", "digest", "weight", "lo")]
                    + [pa.array(s), pa.array(w1), pa.array(w2)],
                    names=["id", "h", "key", "digest", "weight", "lo", "s", "w1", "w2"])

    windows = bodies.select("id", "h", "key", "digest", "weight", "lo", "span", "body").mapInArrow(
        run, f"id {kind}, h long, key long, digest long, weight long, lo int, s long, w1 long, w2 long")
    windows = windows.dropDuplicates(["key", "digest", "s"])
    place = F.struct("id", "h", (F.col("lo") + F.col("s")).alias("p"))
    classes = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("total"), F.min(place).alias("least"))
    hit = windows.join(classes, ["w1", "w2"]).filter(place > F.col("least") if keep_first else F.col("total") > 1)
    return hit.select("key", "digest", "s", (F.col("s") + length).alias("e"))


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "first", id_col: str = "doc_id",
                   text_col: str = "text", gram: int = GRAM, group: int = GROUP_SEGMENTS) -> DataFrame:
    """Byte ranges to remove: (id, h, spans), ``h`` being xxhash64 of the text's bytes.

    ``keep="first"`` leaves the first copy (by id, nulls first, then by text
    hash and place) and marks bytes of later copies; ``keep="none"`` marks
    every copy.  Ranges may overlap.  Texts without any do not appear.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and below length")
    first = keep == "first"
    python_batches(docs.sparkSession, BATCH_BYTES)
    keyed = _text_key(docs, id_col, text_col)
    every = stored(_all_segments(keyed, length, gram), "segments")
    # Stored, so that both sides of the join are shuffled for it and a hot key can be split.
    shared = stored(every.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key"), "shared-keys")
    occ = stored(every.join(shared, "key"), "shared-segments")
    alike = occ.groupBy("key", "digest").agg(
        F.sum("times").alias("weight"), F.min(F.struct("id", "h", "lo")).alias("at"),
        F.first("span").alias("span"), F.first("rel").alias("rel"))
    per_key = alike.groupBy("key").agg(F.count("*").alias("distinct"))
    firsts = alike.join(per_key, "key").select(
        "at.id", "at.h", "at.lo", "key", "digest", "weight", "distinct", "span", "rel")
    bodies = _bodies(keyed, firsts, length)
    if per_key.filter(F.col("distinct") > group).isEmpty():
        matches = _sorted_matches(bodies, length, gram, first)
    else:
        bodies = stored(bodies, "bodies")
        matches = _sorted_matches(bodies.filter(F.col("distinct") <= group), length, gram, first).union(
            _counted_matches(bodies.filter(F.col("distinct") > group), length, first))
    lo, step = F.col("lo").cast("long"), F.col("span") + 1
    end = lo + (F.col("times") - 1) * step + F.col("span") + length  # of the last of equal segments in a row
    if first:
        # Later occurrences of a segment go as a whole, its first one where it matches something earlier.
        here = occ.join(alike.select("key", "digest", "at"), ["key", "digest"])
        lead = F.struct("id", "h", "lo").eqNullSafe(F.col("at"))
        whole = here.filter(~lead | (F.col("times") > 1)).select(
            "id", "h", F.when(lead, lo + step).otherwise(lo).alias("s"), end.alias("e"))
        part = here.filter(lead).join(matches, ["key", "digest"]).select(
            "id", "h", (lo + F.col("s")).alias("s"), (lo + F.col("e")).alias("e"))
        spans = whole.union(part)
    else:
        spans = occ.join(matches, ["key", "digest"]).select(
            "id", "h", (lo + F.col("s")).alias("s"), F.when(F.col("times") > 1, end).otherwise(lo + F.col("e")).alias("e"))
    return spans.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _with_spans(rows: DataFrame, spans: DataFrame, first: bool) -> DataFrame:
    """(row, spans, whole) of ``rows(id, h, row)``; ``whole``: a later one of rows that are equal in id and text."""
    marks = spans.select(F.col("id").alias("span_id"), F.col("h").alias("span_h"), "spans")
    same = (F.col("h") == F.col("span_h")) & F.col("id").eqNullSafe(F.col("span_id"))
    copies = None
    if first:
        copies = stored(rows.groupBy("id", "h").count().filter("count > 1").select(
            F.col("id").alias("copy_id"), F.col("h").alias("copy_h")), "copies")
        copies = None if copies.isEmpty() else copies
    marked = rows.join(marks, same, "left")
    if copies is None:
        return marked.select("row", "spans", F.lit(False).alias("whole"))
    again = (F.col("h") == F.col("copy_h")) & F.col("id").eqNullSafe(F.col("copy_id"))
    alone = marked.join(copies, again, "left_anti").select("row", "spans", F.lit(False).alias("whole"))
    # The first of equal rows is treated by its spans; which one that is among them does not matter.
    numbered = row_number_within(rows.join(copies, again, "left_semi"), ["id", "h"], ["row"], out="place")
    return alone.union(numbered.join(marks, same, "left").select("row", "spans", (F.col("place") > 1).alias("whole")))


def _keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return with_row(docs, F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))


def _removed(spans: pa.ListScalar, whole: bool, size: int) -> list[tuple[int, int]]:
    """Merged removed runs, ascending."""
    if whole:
        return [(0, size)] if size else []
    if not spans.is_valid or not len(spans.values):
        return []
    s, e = (np.sort(spans.values.field(c).to_numpy()) for c in ("s", "e"))
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    return list(zip(s[np.concatenate([[0], cut])].tolist(), e[np.concatenate([cut - 1, [len(e) - 1]])].tolist()))


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def dedup_digest(docs: DataFrame, length: int = 400, keep: str = "none", id_col: str = "doc_id",
                 text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts below ``length`` bytes stay
    whole; texts of any size are read whole.  Repeated rows are copies of each
    other: with ``keep="first"`` one of them is the first and the others go
    whole.  Null ids are ids; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _with_spans(_keyed_rows(given, "id", "text"), repeated_spans(given, length, keep, "id", "text", **options),
                       keep == "first").select("row.id", "row.text", "spans", "whole")
    kind = dict(given.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, whole in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                raw = (text.as_py() or "").encode()
                runs = _removed(spans, whole, len(raw))
                out.append((len(raw), sum(b - a for a, b in runs), len(runs),
                            hashlib.sha256(_kept(raw, runs)).hexdigest()))
            n, removed, pieces, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()),
                pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def dedup_documents(docs: DataFrame, length: int = 400, keep: str = "first", **options) -> DataFrame:
    """The documents with repeated strings taken out of ``text``, columns as in ``docs``, whatever their names.

    A character that loses some of its bytes goes as a whole; n_chars, where
    there is one, is counted anew.  A text that loses everything stays, empty;
    of rows equal in doc_id and text one keeps its text with ``keep="first"``.
    Null and empty texts, and texts below ``length`` bytes, stay; texts of any
    size are read whole; null ids are ids; an empty table gives no rows.
    """
    rows = _with_spans(_keyed_rows(docs, "doc_id", "text"), repeated_spans(docs, length, keep, **options),
                       keep == "first")
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, whole in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                if not text.is_valid or not (spans.is_valid or whole):
                    texts.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                texts.append(_kept(raw, _removed(spans, whole, len(raw))).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    # The old text goes to Python once, beside the row without it.
    bare = F.col("row").withField("text", F.lit(None).cast("string"))
    return with_text(rows.select(bare.alias("row"), F.col("row.text").alias("text"), "spans", "whole").mapInArrow(
        run, schema), docs)
