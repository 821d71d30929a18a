"""Embedding whitening with distributed block matrices.

1. Entries become integers; every different vector is fitted once, so a
   vector with very many copies counts as one.
2. The different vectors are numbered 0..n-1 and centred on their exact mean;
   an ``IndexedRowMatrix`` lays them out as a ``BlockMatrix``.
3. The block matrix's transpose times itself is the scatter matrix.  Its inner
   dimension is split, so that partial products are added up in many tasks
   and only (columns x columns) blocks meet.
4. The scatter matrix, of the size of one vector squared, is decomposed on
   the driver (``eigh``).
5. The block matrix times the whitening matrix projects the rows, which are
   joined back to the vectors that have these entries.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careops.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
# Rows of a block: as many blocks as keep all tasks busy, none of more than 65,536 rows.
LEAST_ROWS, MOST_ROWS, BLOCKS = 1024, 1 << 16, 4096
# Entries beyond this are taken as this.
BOUND = 1 << 45
_RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): entries as floor(64 c) + 1,000,000; vectors that are null, or with null or non-finite entries, go.

    Vectors of another length than most (ties: the longer) go as well.
    """
    c = F.col("v")
    broken = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        c.isNotNull() & ~broken & (F.size(c) > 0))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(SCALE * e, F.lit(-float(BOUND))), F.lit(float(BOUND)))) + SHIFT)
    return rows.select("id", x.cast("array<long>").alias("x"))


def _commonest_length(rows: DataFrame) -> int:
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return best["d"] if best else 0


def fit_list(rows: DataFrame) -> DataFrame:
    """(i, x): every different vector once, numbered without gaps; stored."""
    different = rows.select("x").distinct()
    number = F.monotonically_increasing_id()
    placed = stored(different.select(
        "x", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("within")), "fit-list")
    # One row a partition: where its numbers begin.
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("within")).alias("i"), "x")


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """(n, sums, least and greatest entries by dimension), exact."""
    entry = [F.col("x")[j] for j in range(d)]
    exact = lambda e: F.sum(e.cast("decimal(20,0)"))
    row = fit.agg(F.count("*"), *[f(e) for f in (exact, F.min, F.max) for e in entry]).first()
    return row[0], [int(s) for s in row[1:1 + d]], list(row[1 + d:1 + 2 * d]), list(row[1 + 2 * d:])


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _blocks(centred: DataFrame, rows_per_block: int, d: int) -> BlockMatrix:
    """A block matrix of (i, centred) rows, laid out by Spark without Python."""
    given = MLUtils.convertVectorColumnsFromML(
        centred.select(F.col("i").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(given).toBlockMatrix(rows_per_block, d)


def _small(spark: SparkSession, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A matrix of one block."""
    d, k = matrix.shape
    block = DenseMatrix(d, k, matrix.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), rows_per_block, k)


def _scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times the matrix itself, the inner dimension in ``splits`` parts."""
    flipped = blocks.transpose()
    product = flipped._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, flipped.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _release(blocks: BlockMatrix) -> None:
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _rows(spark: SparkSession, blocks: BlockMatrix) -> DataFrame:
    """(i, w) of a block matrix, as a DataFrame without Python rows."""
    frame = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return frame.select(F.col("index").alias("i"), vector_to_array("vector").alias("w"))


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, by falling eigenvalue.

    Directions without variance (to double precision) are left out.  The sign
    is that which makes a component's largest entry positive.
    """
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(values) * np.finfo(float).eps * max(values.max(), 0.0)]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    return values, vectors, float(np.trace(covariance))


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``n`` is the number of different vectors, ``deviation`` the exact sum of
    (n x - S)^2 (null where it does not fit a long), ``explained`` the
    component's share of the variance, ``identity_error`` the largest entry of
    the whitened fit list's covariance less the identity.  Vectors that are
    null, empty, or hold null or non-finite entries are dropped, and those of
    another length than most; entries beyond 2^45 / 64 count as that.  Null
    ids, repeated ids and equal vectors keep their rows.  Components without
    variance are left out: a table of one different vector gives no rows, nor
    does an empty one.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.select(F.col(id_col).alias("id")).dtypes)["id"]
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, {_RESULT}")
    every = stored(integer_vectors(vectors, id_col, vector_col), "integer-vectors")
    d = _commonest_length(every)
    if not d:
        return empty
    rows = every.filter(F.size("x") == d)
    fit = fit_list(rows)
    n, sums, least, greatest = _sums(fit, d)
    gaps = F.zip_with(F.col("x"), _longs(sums), lambda x, s: F.lit(n) * x - s)
    widest = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, greatest, sums)]
    if max(widest) >= 1 << 62 or sum(w * w for w in widest) >= 10 ** 38:
        raise ValueError("entries too far apart for exact sums")
    fits_long = sum(w * w for w in widest) < 1 << 63
    number = "long" if fits_long else "decimal(38,0)"
    deviation = F.aggregate(gaps, F.lit(0).cast(number), lambda a, g: (a + g.cast(number) * g.cast(number)).cast(number))
    centred = stored(fit.select("i", "x", F.transform(gaps, lambda g: g / F.lit(n)).alias("centred"),
                                deviation.try_cast("long").alias("deviation")), "centred")

    rows_per_block = min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
    splits = -(-n // rows_per_block)
    blocks = _blocks(centred, rows_per_block, d).persist(StorageLevel.MEMORY_AND_DISK)
    values, basis, trace = components(_scatter(blocks, splits), n, most)
    k = len(values)
    if not k:
        _release(blocks)
        return empty
    projected = blocks.multiply(_small(spark, basis / np.sqrt(values), d))
    whitened = stored(_rows(spark, projected), "whitened")
    _release(blocks)
    again = _blocks(whitened.withColumnRenamed("w", "centred"), rows_per_block, k)
    error = float(np.abs(_scatter(again, splits) / n - np.eye(k)).max())

    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    known = centred.select("i", "x", "deviation").join(whitened, "i")
    key = F.xxhash64("x").alias("h")
    found = rows.select("id", key, "x").join(known.select(key, "x", "deviation", "w"), ["h", "x"])
    return found.select(
        F.col("id").alias(id_col), "deviation", F.posexplode(F.col("w")).alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
