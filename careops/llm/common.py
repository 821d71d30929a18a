"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.functions.materialize import checkpoint
from careops.session import ensure_checkpoint_dir

# Bytes of input per Arrow batch: bounds a Python worker's memory whatever the
# number of rows; a single longer row comes alone.
ARROW_BYTES = 8 << 20


def python_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the Arrow batches that Python workers get, by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and all of a caller's columns as one struct ``row``, so that no name of theirs meets one of ours."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from (row, text): ``text`` replaced, n_chars, where there is one, counted anew."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts the lineage, compressed)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as (bytes, offsets); null counts as empty."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int):
    """Row ranges whose texts take about ``size`` bytes (a longer row comes alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


__all__ = ["ARROW_BYTES", "byte_column", "checkpoint", "id_remainder", "python_batches", "scratch_path", "slices",
           "stored", "with_row", "with_text"]
