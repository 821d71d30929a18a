"""Exact top-k by inner product with a three-phase uniform threshold.

A score is a sum of partial scores, one for each of ``lists`` groups of
components.  Queries and candidates are laid out in blocks, every pair of
blocks is one unit of work, and each phase is one pass over the pairs.

1. For each query and each list, a block gathers its candidates with the
   highest partial scores and resolves their totals; the k-th highest total
   over all blocks is a safe cutoff: no answer scores below it.
2. The cutoffs travel with the query blocks to all units.  A total that
   reaches the cutoff has a partial score of at least cutoff / lists in some
   list, so entries below that in every list are never looked at again.
3. The totals of the remaining entries are resolved exactly; those that reach
   the cutoff, at most k a block, are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.common import python_batches, stored

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
_NO_CUTOFF = -(1 << 63)


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """``count`` rows (name, n, width, ids, cutoffs, data), the rows dealt evenly whatever their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        vectors = table.column("q").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        grid = np.zeros((len(sizes), int(sizes.max())), np.int64)
        grid[np.arange(grid.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(sizes)], pa.int32()),
            pa.array([grid.shape[1]], pa.int32()),
            *(pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
              for c in ("id", "row", "cutoff")),
            pa.array([_narrow(grid).tobytes()], pa.binary())],
            names=[name, "n", "width", "ids", "rows", "cutoffs", "data"])

    schema = f"{name} int, n int, width int, ids binary, rows binary, cutoffs binary, data binary"
    return rows.repartition(count).mapInArrow(run, schema)


def _narrow(grid: np.ndarray) -> np.ndarray:
    """The smallest of 16, 32 and 64 bits that holds all numbers."""
    high = int(np.abs(grid).max(initial=0)) if grid.size else 0
    return grid.astype(np.int16 if 0 <= high < 1 << 15 else np.int32 if 0 <= high < 1 << 31 else np.int64)


def _read(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, width, data = row[f"{side}n"], row[f"{side}width"], row[f"{side}data"]
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * width) if width else 8]
    ids, rows, cut = (np.frombuffer(row[side + c], np.int64) for c in ("ids", "rows", "cutoffs"))
    return ids, rows, cut, np.frombuffer(data, kind).reshape(n, width).astype(np.int64)


def _partials(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact partial scores (queries, candidates) for each list; missing components count as zero."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    # Doubles are exact below 2^53 and much faster; larger numbers take 64-bit integers.
    small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1) < 2.0**53
    kind = np.float64 if small else np.int64
    edges = np.linspace(0, width, lists + 1).astype(int)
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(edges, edges[1:])]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _units(queries: DataFrame, candidates: DataFrame, n_q: int, n_c: int,
           work: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on every pair of a query block and a candidate block."""
    q = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = q.select("qb", "cb", *[F.col(x).alias(f"q{x}") for x in ("n", "width", "ids", "rows", "cutoffs", "data")])
    c = c.select("qb", "cb", *[F.col(x).alias(f"c{x}") for x in ("n", "width", "ids", "rows", "cutoffs", "data")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield work(row)

    return q.join(c.hint("shuffle_hash"), ["qb", "cb"]).mapInArrow(run, schema)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, lists: int = 2, multiplier: float = 64.0,
          id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = CANDIDATE_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest scores of each query row: query_id, rank, vec_id, score.

    Components become floor(multiplier * x) (clipped to 64 bits), the score is
    their integer inner product; shorter vectors count as padded with zeros.
    ``is_query`` picks the queries; every row with another id is a candidate.
    All candidates come back if there are fewer than ``k``; ties go to the
    smaller id.  Null vectors, vectors that hold null or non-finite components
    and null ids take no part; an empty vector scores zero.  Equal query rows
    answer once.  An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    python_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = float(1 << 62)
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * multiplier), F.lit(limit)), F.lit(-limit)).cast("long"))
    given = rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("q"), is_query.alias("is_query"))
    given = stored(given.withColumn("cutoff", F.lit(_NO_CUTOFF)).withColumn("row", F.lit(0).cast("long")), "vectors")
    asked = stored(given.filter("is_query").dropDuplicates(["id", "q"]).withColumn(
        "row", F.monotonically_increasing_id()), "queries")
    n_c = max(1, -(-given.count() // candidate_block))
    n_q = max(1, -(-asked.count() // query_block))
    candidates = stored(_blocks(given, n_c, "cb"), "candidate-blocks")

    def gather(row: dict) -> pa.RecordBatch:
        q_ids, q_rows, _, q = _read(row, "q")
        c_ids, _, _, c = _read(row, "c")
        own = q_ids[:, None] == c_ids
        lowest = -np.inf if len(c_ids) else 0
        seen = np.zeros(own.shape, bool)
        total = 0
        for part in _partials(q, c, lists):
            total = total + part
            np.put_along_axis(seen, _top(np.where(own, lowest, part.astype(np.float64)), k), True, axis=1)
        seen &= ~own
        # The k best totals among the gathered entries of each query.
        best = _top(np.where(seen, total.astype(np.float64), -np.inf), k)
        good = np.take_along_axis(seen, best, axis=1)
        values = np.take_along_axis(total, best, axis=1)[good].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_rows, good.sum(1))), pa.array(values)], names=["row", "score"])

    first = _units(_blocks(asked, n_q, "qb"), candidates, n_q, n_c, gather, "row long, score long")
    by_score = Window.partitionBy("row").orderBy(F.col("score").desc())
    cutoffs = first.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k).groupBy("row").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(_NO_CUTOFF)).alias("cutoff"))
    ready = asked.drop("cutoff").join(cutoffs, "row", "left").withColumn(
        "cutoff", F.coalesce("cutoff", F.lit(_NO_CUTOFF)))

    def resolve(row: dict) -> pa.RecordBatch:
        q_ids, q_rows, cut, q = _read(row, "q")
        c_ids, _, _, c = _read(row, "c")
        parts = _partials(q, c, lists)
        bound = np.where(cut == _NO_CUTOFF, -np.inf, cut.astype(np.float64))[:, None]
        slack = bound - np.abs(np.where(np.isinf(bound), 0, bound)) * 1e-12 - 1e-6
        enough = np.zeros(parts[0].shape, bool)
        for part in parts:  # uniform threshold: some list must hold its share of the cutoff
            enough |= part.astype(np.float64) * len(parts) >= slack
        enough &= q_ids[:, None] != c_ids
        i, j = np.nonzero(enough)
        total = parts[0][i, j]
        for part in parts[1:]:
            total = total + part[i, j]
        total = total.astype(np.int64)
        good = total >= cut[i]
        i, j, total = i[good], j[good], total[good]
        order = np.lexsort((c_ids[j], -total, i))
        i, j, total = i[order], j[order], total[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        few = place < k
        return pa.RecordBatch.from_arrays(
            [pa.array(q_ids[i[few]]), pa.array(q_rows[i[few]]), pa.array(c_ids[j[few]]), pa.array(total[few])],
            names=["query_id", "row", "vec_id", "score"])

    found = _units(_blocks(ready, n_q, "qb"), candidates, n_q, n_c, resolve,
                   "query_id long, row long, vec_id long, score long")
    ranked = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
