"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a short vector of statistics of its bytes, words and
lines, taken from the whole text.  Trees are grown level by level on binned
features (gradients and hessians summed per node, feature and bin), then
flattened into arrays; scoring walks all trees for a whole batch with numpy.

The model is fitted on at most about ``sample`` labelled rows (a documented
bound: rows are chosen by a hash of their id), so what reaches the driver,
the sample's statistics and nothing else, does not grow with the corpus.
Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from careops.llm.common import byte_column, id_remainder, python_batches, slices, with_row
from careops.llm.textscan import Rolling, lower_ascii, word_spans

SAMPLE_ROWS = 40_000
FEATURES = 24

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space, 7 newline, 8 non-ASCII lead.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "!\"#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[ord(c) for c in ".,;:?'()-"]] = 4
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7
_CLASS[0xC0:] = 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) statistics; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(data):
        return out
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    table = np.bincount(text_of * 9 + kinds, minlength=n * 9).reshape(n, 9)
    letters = np.maximum(table[:, 1] + table[:, 2] + table[:, 8], 1)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(float)
    w1 = np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    for k in range(1, 9):
        out[:, 1 + k] = table[:, k] / some
    out[:, 10] = table[:, 2] / letters
    if not len(starts):
        return out
    owner = np.repeat(np.arange(n), np.diff(first))
    lens = (ends - starts).astype(float)

    def per_text(values):
        return np.bincount(owner, values, n)

    mean = per_text(lens) / w1
    out[:, 11] = mean
    out[:, 12] = np.sqrt(np.maximum(per_text(lens * lens) / w1 - mean * mean, 0))
    tail = kinds[ends - 1]
    out[:, 13] = per_text(tail == 5) / w1
    out[:, 14] = per_text(tail == 4) / w1
    out[:, 15] = per_text((lens == 1) & (tail == 5)) / w1
    out[:, 16] = per_text(kinds[starts] == 2) / w1
    out[:, 17] = per_text(tail == 2) / w1
    hashes = Rolling(lower_ascii(data)).spans(starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, 18] = per_text(same) / w1
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    out[:, 19] = np.bincount(o, fresh, n) / w1
    run = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[fresh], run)
    out[:, 20] = most / w1
    out[:, 21] = table[:, 7] / w1
    # Lines: repeated share and mean length.
    newline = np.flatnonzero(data == 10)
    nonempty = np.diff(offsets) > 0
    begin = np.unique(np.concatenate([offsets[:-1][nonempty], newline + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    line_of = text_of[begin]
    lh = Rolling(data).spans(begin, end - (data[end - 1] == 10))
    order = np.lexsort((lh, line_of))
    lh, lo = lh[order], line_of[order]
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[1:] == lh[:-1]) & (lo[1:] == lo[:-1])
    lines = np.maximum(np.bincount(lo, minlength=n), 1)
    out[:, 22] = np.bincount(lo, again, n) / lines
    out[:, 23] = size / lines
    return out


@dataclass
class Trees:
    """Flattened trees: node arrays of shape (trees, nodes); a leaf has feature -1."""

    edges: np.ndarray  # (features, bins - 1) upper bin edges
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, child, value in zip(self.feature, self.threshold, self.child, self.value):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = child[node] + (x[rows, np.maximum(f, 0)] > threshold[node])
                node = np.where(inner, go, node)
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss; without rows every score is 0.5, with one class its smoothed share."""
    n, width = x.shape
    edges = np.zeros((width, bins - 1))
    if n:
        edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T.copy()
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1) if n else x
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    threshold, value = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    child = np.zeros((trees, nodes), np.int64)
    margin = np.full(n, base)
    for t in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        level, used = [0], 1
        for _ in range(depth):
            slot = np.full(nodes, -1)
            slot[level] = np.arange(len(level))
            rows = np.flatnonzero(slot[node] >= 0)
            if not len(rows):
                break
            at = slot[node[rows]]
            best = np.full(len(level), 1e-6)
            choice = np.full((len(level), 2), -1)
            for f in range(width):
                cell = at * bins + binned[rows, f]
                shape = (len(level), bins)
                g = np.bincount(cell, grad[rows], len(level) * bins).reshape(shape).cumsum(1)
                h = np.bincount(cell, hess[rows], len(level) * bins).reshape(shape).cumsum(1)
                c = np.bincount(cell, minlength=len(level) * bins).reshape(shape).cumsum(1)
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g)**2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = np.where((c >= least) & (ct - c >= least), gain, 0)[:, :-1]
                pick = gain.argmax(1)
                value_at = gain[np.arange(len(level)), pick]
                better = value_at > best
                best[better] = value_at[better]
                choice[better] = np.stack([np.full(len(level), f), pick], 1)[better]
            following = []
            for i, parent in enumerate(level):
                if choice[i, 0] < 0:
                    continue
                f, b = choice[i]
                feature[t, parent], threshold[t, parent], child[t, parent] = f, edges[f, b], used
                own = rows[at == i]
                node[own] = used + (binned[own, f] > b)
                following += [used, used + 1]
                used += 2
            level = following
        leaf_g = np.bincount(node, grad, nodes)
        leaf_h = np.bincount(node, hess, nodes)
        value[t] = -rate * leaf_g / (leaf_h + ridge)
        margin += value[t][node]
    return Trees(edges, feature, threshold, child, value, base)


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                x = statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))],
                    names=["id", "x"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE_ROWS,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on labelled rows: ``train`` filters the ids, labels other than 0 and 1 (null too) are left out.

    At most about ``sample`` (id, label) pairs are used, chosen by a hash of
    the id, all of them if there are fewer; only they reach the driver.  An id
    labelled both ways counts with each label.  Of rows that repeat an id one
    counts, that with the least statistics; rows with a null id are left out.
    Null and empty texts have the statistics of a text without any byte; very
    long texts are read whole.  Without labels every score is one half.
    Other columns are ignored.
    """
    python_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if train is not None:
        marked = marked.filter(train)
    marked = marked.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    share = min(1.0, sample / max(1, marked.count()))

    def chosen(df: DataFrame, column: str) -> DataFrame:
        if share >= 1.0:
            return df
        return df.filter(F.pmod(F.xxhash64(F.col(column), F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))

    part = chosen(docs.filter(F.col(id_col).isNotNull()).filter(train) if train is not None else docs, id_col)
    rows = _features(part, id_col, text_col).join(chosen(marked, "id"), "id").groupBy("id", "y").agg(
        F.min("x").alias("x")).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    y = rows["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of arrival
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, score)`` for every row; null and empty texts score like a text without any byte.

    The broadcast model has a fixed size (trees x nodes).  Repeated rows and
    null ids pass through; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    python_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            scores = [np.zeros(0)]
            for i, j in slices(offsets, 1 << 20):
                scores.append(held.value.score(statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.concatenate(scores))], names=[*batch.schema.names[1:], "score"])

    cols = list(dict.fromkeys([id_col, *keep]))
    schema = StructType([docs.schema[c] for c in cols]).add("score", "double")
    return docs.select(F.col(text_col).alias("__text"), *cols).mapInArrow(run, schema)


def train_split() -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return id_remainder("doc_id", 5) != 0


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns of ``docs``, whatever their names.

    Null and empty texts are scored like a text without any byte, texts of any
    length whole.  Null ids, ties and repeated rows are scored row by row; an
    empty table gives no rows.
    """
    model = fit_quality(docs, labels, train_split())
    scored = score_quality(with_row(docs, "text"), model, id_col="row")
    return scored.filter(F.col("score") >= threshold).select("row.*")
