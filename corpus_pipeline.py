"""A training corpus from raw documents: filter, deduplicate twice, mix, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; between stages the documents are written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careops.llm.common import stored
from careops.llm.mixing import mixed_documents
from careops.llm.packing import Capacity, pack_documents
from careops.llm.quality import keep_good
from careops.llm.queries import tokenizer
from careops.llm.simhash import keep_first
from careops.llm.suffix_dedup import dedup_documents
from careops.session import configure


# Bytes of a repeat: below those of any fifty words of prose (234 at least, 314 in the middle, in the test tables).
REPEAT_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (four-word shingles, at most four differing bits)."""
    return keep_first(docs, shingle=4, radius=4)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of ``REPEAT_BYTES`` bytes are taken out of the texts; the first copy stays."""
    return dedup_documents(docs, length=REPEAT_BYTES, keep="first")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each pass that takes words of it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 2048 tokens."""
    capacity = Capacity(tokens=2048, documents=2048, attention=2048 ** 2)
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("source_mixing", mixture),
    ("best_fit_packing", packing),
]

# A classifier, hash classes and byte-exact token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
