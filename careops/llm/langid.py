"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the normalised TF-IDF vector of its hashed letter n-grams (one
to three bytes of lower-cased letters, with word boundaries).  Each language
has several centroids, clustered by cosine from its training texts; a text
gets the language of the nearest one, or ``und`` beyond the rejection distance.

Document frequencies come from all training rows.  Centroids are clustered
from at most ``sample`` training rows for each language (a documented bound;
rows are chosen by a hash of their id), one group per language in the
executors.  The driver sees document frequencies, one number per hashed
n-gram, and the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.common import byte_column, id_remainder, python_batches, slices, stored

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
UNKNOWN = "und"

# Lower-cased letters (any byte above 127 counts as part of one), other bytes as 0.
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMENSIONS) counts of hashed n-grams."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if not len(data):
        return out
    # A zero between texts, so that no n-gram spans two of them.
    text = np.repeat(np.arange(n), np.diff(offsets))
    letters = np.zeros(len(data) + n + 1, np.uint32)
    at = np.arange(len(data)) + text + 1
    letters[at] = _LETTER[data]
    a, b, c = letters[at - 1], letters[at], letters[at + 1]
    shift = np.uint32(32 - int(np.log2(DIMENSIONS)))
    total = np.zeros(n * DIMENSIONS, np.int64)
    base = text * DIMENSIONS
    for code, use in ((b, b > 0), (b | (c << 8) | (1 << 24), (b > 0) | (c > 0)), (a | (b << 8) | (c << 16), b > 0)):
        slot = ((code[use].astype(np.uint32) * np.uint32(2654435761)) >> shift).astype(np.int64)
        total += np.bincount(base[use] + slot, minlength=n * DIMENSIONS)
    out[:] = total.reshape(n, DIMENSIONS)
    return out


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (logarithmic counts); a row without n-grams stays zero."""
    x = np.log1p(table) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter in the sense of Unicode."""
    ascii_letter = (_LETTER[data] > 0) & (data < 128)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit centroids of unit rows by spherical k-means, started far apart."""
    start = [0]
    best = x @ x[0]
    for _ in range(1, min(k, len(x))):
        far = int(best.argmin())
        if best[far] > 0.999:
            break
        start.append(far)
        best = np.maximum(best, x @ x[far])
    centers = x[start]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in range(len(centers))])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers).astype(np.float32)
    return centers


class LanguageModel:
    """Document weights, centroids and the language of each centroid."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str]):
        self.idf, self.centers, self.langs = idf, centers, langs

    def nearest(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest centroid, cosine) per row."""
        if not self.langs:
            return np.zeros(len(table), np.int64), np.zeros(len(table))
        near = weighted(table, self.idf) @ self.centers.T
        pick = near.argmax(axis=1)
        return pick, np.clip(near[np.arange(len(near)), pick], 0, 1).astype(float)


def fit_languages(docs: DataFrame, train: Column | None = None, sample: int = SAMPLE_PER_LANGUAGE,
                  centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> LanguageModel:
    """Fit on rows with text and language; ``train`` filters them further.

    Document frequencies cover all such rows.  The centroids are those of
    ``sample`` different (id, text) pairs a language at most, the ones with
    the smallest hashes, so that a repeated id or row counts once; only they
    meet in one task a language.  Rows with a null id count for the
    frequencies alone.  Empty texts weigh nothing; very long texts are read
    whole; a language without any n-gram has no centroid; an empty table
    teaches nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    python_batches(spark)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.filter(train) if train is not None else known

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                table = counts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                total += (table > 0).sum(axis=0)
                texts += j - i
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMENSIONS + 1), pa.int32()), pa.array(np.append(total, texts))], names=["slot", "n"])

    sums = known.select(text_col).mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).collect()  # one number for each hashed n-gram
    df = np.zeros(DIMENSIONS + 1)
    for row in sums:
        df[row.slot] = row.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 0.01

    # A bounded number of (id, text) pairs for each language, those with the smallest hashes.
    keyed = known.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"),
        F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("lang")), "id", "h")
    chosen = keyed.select("lang", "id", "h").distinct().withColumn("r", F.row_number().over(order)).filter(
        F.col("r") <= sample).select("lang", "id", "h")
    # Written, so that the planner knows its size: a small one is broadcast and no text is shuffled for the join.
    chosen = stored(chosen, "chosen-texts")
    texts = keyed.join(chosen, ["lang", "id", "h"], "left_semi").dropDuplicates(["lang", "id", "h"])

    def centers(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "h"])
        parts = []
        column = pa.array(frame["text"], pa.string())
        data, offsets = byte_column(column)
        for i, j in slices(offsets, 1 << 20):
            parts.append(weighted(counts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), idf))
        x = np.concatenate(parts).astype(np.float32)
        x = x[(x * x).sum(axis=1) > 0.5]
        found = cluster(x, centroids) if len(x) else np.zeros((0, DIMENSIONS), np.float32)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * len(found), "center": [c.tobytes() for c in found]})

    rows = texts.groupBy("lang").applyInPandas(centers, "lang string, center binary").collect()
    rows = sorted((r.lang, bytes(r.center)) for r in rows)
    matrix = np.array([np.frombuffer(c, np.float32) for _, c in rows], np.float32).reshape(-1, DIMENSIONS)
    return LanguageModel(idf, matrix, [lang for lang, _ in rows])


def predict_languages(docs: DataFrame, model: LanguageModel, reject_below: float = 0.0, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (cosine with the nearest centroid, 0 to 1).

    ``und`` with score 0: null, empty and letterless texts, everything if
    nothing was learned; ``und`` with its score: a text whose cosine is below
    ``reject_below`` (one minus the rejection distance).  Ties go to the
    language first in order.  Repeated rows and null ids pass through; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    python_batches(spark)
    held = spark.sparkContext.broadcast(model)  # centroids: languages x CENTROIDS x DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array(model.langs + [UNKNOWN], object)
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                pick, score = model.nearest(counts(part, at))
                letters = has_letter(batch.column(1).slice(i, j - i), part, at)
                score = np.where(letters, score, 0.0)
                known = letters & (score >= reject_below) & bool(model.langs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(names[np.where(known, pick, -1)], pa.string()),
                    pa.array(score)], names=["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(
        run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def train_split() -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return id_remainder("doc_id", 4) != 2
