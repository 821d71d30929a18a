"""Best-fit packing of tokenised documents into sequences, with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths).  Pieces come by falling length; each goes to
the open sequence that fits under every constraint and scores best: either
the largest weighted dot product of what the piece needs with what the
sequence has left, or the smallest weighted norm of what would be left.

Documents longer than a sequence are cut; full pieces are sequences of their
own.  The other pieces are dealt evenly to groups of bounded size, whatever
their keys, and every group is packed by itself: a group wastes at most about
one sequence, however large the corpus is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.llm.common import byte_column, python_batches, slices, stored
from careops.llm.encode import CALL_BYTES, Encoder, with_end

GROUP_PIECES = 16384


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds.  ``documents`` and ``attention`` may be None: no limit."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"


def pack_group(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece and the number of sequences.

    A piece that breaks a constraint even alone gets a sequence of its own.
    Ties go to the sequence opened first.
    """
    n = len(lengths)
    scale = np.array([cap.tokens, cap.documents or 0, cap.attention or 0], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1)
    used = scale > 0
    scaled = np.where(used, need / np.where(used, scale, 1), 0)
    weights = np.asarray(cap.weights) * used
    order = np.lexsort((np.arange(n), -lengths))
    room = np.zeros((n, 3))  # open sequences, compact: rows 0..m-1
    name = np.zeros(n, np.int64)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    filled = np.zeros(n, np.int64)
    m = opened = 0
    least = int(lengths.min()) / cap.tokens if n else 0
    for step, i in enumerate(order):
        want = scaled[i]
        if step % 256 == 0 and m:  # sequences that no piece fits any more are closed
            alive = (room[:m, 0] >= least - 1e-12) & (~used[1:] | (room[:m, 1:] > 1e-12)).all(axis=1)
            k = int(alive.sum())
            room[:k], name[:k] = room[:m][alive], name[:m][alive]
            m = k
        left = room[:m] - want
        fits = np.flatnonzero((left >= -1e-9).all(axis=1))
        if len(fits):
            if cap.rule == "dot":
                best = fits[np.argmax(room[fits] @ (weights * want))]
            else:
                best = fits[np.argmin((left[fits] ** 2) @ weights)]
            room[best] -= want
        else:
            best = m
            room[best], name[best] = used - want, opened
            opened += 1
            m += 1
        sequence[i] = name[best]
        offset[i] = filled[name[best]]
        filled[name[best]] += lengths[i]
    return sequence, offset, opened


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of the tokenised documents: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    python_batches(docs.sparkSession)
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, CALL_BYTES):
                ids, at = with_end(*encoder.encode(batch.column(1).slice(i, j - i).to_pylist()), end)
                sizes = np.diff(at)
                pieces = -(-sizes // length)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                count = np.minimum(length, sizes[row] - start)
                begin = at[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * b:4 * (b + c)]) for b, c in zip(begin.tolist(), count.tolist())]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[b:b + c] for b, c in zip(begin, count)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def pack(pieces: DataFrame, cap: Capacity, group: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` column."""
    n = pieces.filter(F.col("length") < cap.tokens).count()
    groups = max(1, -(-n // group))
    schema = pieces.schema.simpleString()[len("struct<"):-1] + ",sequence_id:bigint,offset:bigint"
    low = pieces.filter(F.col("length") < cap.tokens)
    full = pieces.filter(F.col("length") >= cap.tokens)

    def run(batches: Iterator[pa.RecordBatch], alone: bool = False) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        following = (TaskContext.get().partitionId() * 2 + alone) << 31
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following, held
            table = pa.Table.from_batches(held)
            held = []
            lengths = table.column("length").to_numpy()
            if alone:
                sequence, offset, used = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), len(lengths)
            else:
                sequence, offset, used = pack_group(lengths, cap)
            table = table.append_column("sequence_id", pa.array(sequence + following))
            following += used
            yield from table.append_column("offset", pa.array(offset)).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * group:
                yield from flush()
        if held:
            yield from flush()

    # Round robin gives every task the same number of pieces, whatever the keys are.
    packed = low.repartition(groups).mapInArrow(lambda b: run(b), schema)
    return packed.union(full.mapInArrow(lambda b: run(b, True), schema))


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every document: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows, null ids and
    ties are packed each by itself; an empty table gives no rows; other
    columns are ignored.  Very long texts are cut into pieces of ``cap.tokens``.
    """
    pieces = token_pieces(docs, tokenizer, cap.tokens, end, id_col, text_col, with_ids)
    return pack(stored(pieces, "pieces"), cap).withColumnRenamed("id", id_col)
