"""Token ids in a binary format of patched frame-of-reference blocks.

A segment holds some documents: their lengths and all their ids, each cut
into blocks of 256 numbers.  A block stores its minimum, a width, the numbers
less the minimum packed at that width, and an exception list (place, value)
for the few that need more bits; the width is a percentile of the widths that
the block's numbers need.  An index of block starts lets a reader decode any
block alone.

Segments are rows (part, segment, body) of a Parquet table in the shared
folder, so that any Spark reader and any store can hold them; parts and
segments ascend with the document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careops.llm.common import byte_column, python_batches, slices
from careops.llm.encode import CALL_BYTES, Encoder, with_end

BLOCK = 256
SEGMENT_IDS = 1 << 20
MAGIC = b"PFR1"


def _pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) numbers of ``width`` bits as (blocks, 4 * width) 64-bit words."""
    lanes = np.ascontiguousarray(values.T.astype(np.uint64))
    words = np.zeros((BLOCK * width // 64, lanes.shape[1]), np.uint64)
    for j in range(BLOCK):
        k, shift = divmod(j * width, 64)
        words[k] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[k + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, lanes.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        k, shift = divmod(j * width, 64)
        value = lanes[k] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (lanes[k + 1] << np.uint64(64 - shift))
        out[j] = value & mask
    return out.T


def pack_numbers(values: np.ndarray, percentile: float = 0.9) -> bytes:
    """Patched frame-of-reference bytes of unsigned 32-bit numbers.

    Count and number of blocks; then, for each block, its start, minimum,
    width and number of exceptions; then the blocks: packed numbers, places
    and values of exceptions.
    """
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<II", 0, 0)
    padded = np.full(blocks * BLOCK, values[-1], np.uint32)
    padded[:n] = values
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = int(percentile * (BLOCK - 1))
    width = np.partition(bits, at, axis=1)[:, at]
    out = bits > width[:, None]
    counts = out.sum(1)
    rest_kept = np.where(out, np.uint32(0), rest)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        body, size = _pack_words(rest_kept[own], w).astype("<u8").tobytes(), BLOCK * w // 8
        for i, b in enumerate(own.tolist()):
            packed[b] = body[i * size:(i + 1) * size]
    block, place = np.nonzero(out)
    places, values_out = place.astype(np.uint8).tobytes(), rest[block, place].astype("<u4").tobytes()
    edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
    parts = [packed[b] + places[edges[b]:edges[b + 1]] + values_out[4 * edges[b]:4 * edges[b + 1]] for b in range(blocks)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    return b"".join([struct.pack("<II", n, blocks), starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(),
                     width.tobytes(), counts.astype(np.uint8).tobytes(), *parts])


def unpack_numbers(body: memoryview) -> tuple[np.ndarray, int]:
    """The numbers, and how many bytes they took."""
    n, blocks = struct.unpack_from("<II", body)
    if not n:
        return np.zeros(0, np.uint32), 8
    head = 8 + 10 * blocks
    starts = np.frombuffer(body, "<u4", blocks, 8).astype(np.int64) + head
    low = np.frombuffer(body, "<u4", blocks, 8 + 4 * blocks)
    width = np.frombuffer(body, np.uint8, blocks, 8 + 8 * blocks).astype(np.int64)
    counts = np.frombuffer(body, np.uint8, blocks, 8 + 9 * blocks).astype(np.int64)
    raw = np.frombuffer(body, np.uint8)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        rows = raw[starts[own][:, None] + np.arange(size)]
        grid[own] = _unpack_words(np.ascontiguousarray(rows).view("<u8"), w)
    after = starts + BLOCK * width // 8
    block = np.repeat(np.arange(blocks), counts)
    k = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = raw[after[block] + k]
    value_at = (after + counts)[block] + 4 * k
    grid[block, place] = np.ascontiguousarray(raw[value_at[:, None] + np.arange(4)]).view("<u4").ravel()
    grid += low[:, None]
    return grid.ravel()[:n], int(after[-1] + 5 * counts[-1])


def write_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    return MAGIC + pack_numbers(lengths.astype(np.uint32)) + pack_numbers(ids)


def read_segment(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a segment."""
    view = memoryview(body)
    if view[:4] != MAGIC:
        raise ValueError("not a token segment")
    lengths, used = unpack_numbers(view[4:])
    return unpack_numbers(view[4 + used:])[0], lengths.astype(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the token files of all documents, in ascending id order, to ``path``.

    Null texts count as empty (the end id alone); null ids come first; rows of
    one id follow each other by text.  Other columns are not stored.
    """
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, names, segment
            every, sizes = np.concatenate(ids), np.concatenate(lengths)
            doc_ids = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(every)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                pa.array([write_segment(every, sizes)], pa.binary()),
            ], names=["part", "segment", "n_ids", "ids", "body"])
            ids, lengths, names, segment = [], [], [], segment + 1
            return row

        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, 2 * CALL_BYTES):
                some, at = with_end(*encoder.encode(batch.column(1).slice(i, j - i).to_pylist()), end)
                ids.append(some)
                lengths.append(np.diff(at))
                names.append(batch.column(0).slice(i, j - i))
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    kind = dict(docs.dtypes)[id_col]
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(
        F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, f"part int, segment int, n_ids long, ids array<{kind}>, body binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: id, start (ids of all documents before it), n_tokens, ids_crc32[, ids]."""
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["ids"][len("array<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, names, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                  batch.column(2), batch.column(3)):
                ids, lengths = read_segment(body.as_py())
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(lengths)
                columns = [names.values, pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()),
                           pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["id", "part", "segment", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    python_batches(spark)
    rows = files.select("part", "segment", "ids", "body").mapInArrow(
        run, f"id {kind}, part int, segment int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # Starts of segments: inside a part, and over the parts (one row each).
    sizes = files.select("part", "segment", "n_ids")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(parts, "part").select(
        "part", "segment", (F.col("base") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "segment"]).withColumn("start", F.col("first") + F.col("within")).select(
        "id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
