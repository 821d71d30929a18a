"""Mixing sources to target weights, DataFrame expressions only.

The words of each source are laid end to end in a pseudorandom document order
and cut into blocks of ``block`` words.  The mix is a row of output shards of
``shard`` slots; for each shard every source gets the whole part of its
expected slots, and the slots left over are drawn multinomially from the
fractional parts.  The i-th slot of a source takes block
``permutation(i mod blocks)`` of its stream, with another pseudorandom
permutation for each pass; blocks are joined to slots by index.

Running totals are taken in two levels (inside bounded chunks, then over the
chunks), so a source that holds most of the corpus is never one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.common import checkpoint, with_row, with_text

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
CHUNK_ROWS = 4096
MAX_PASSES = 3
# Primes for the index permutations (fixed values).
PRIMES = (1000003, 1299709)
CELLS = 256

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the same ``keys``, by ``chunk``, then ``order``."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__t")).withColumn(
        "__base", F.coalesce(F.sum("__t").over(outer), F.lit(0))).drop("__t")
    local = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(totals, [*keys, chunk]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: sid, weight, source_size, target, blocks.

    ``sizes``: (source, source_size, n_rows).  Sources by code point, null
    last, weigh 1, 2, 3, 1, ...; a target stops at three times its source's
    size and the excess is shared by weight among the others until none is
    above.  That is the level L with sum(min(3 size, L weight)) = total: by
    rising 3 size / weight, a source is capped while the level that the rest
    would get still exceeds its own cap.  One row per source goes through the
    windows, never documents.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(MAX_PASSES))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    ranked = ranked.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "sid", "source_size", "n_rows", target.alias("target"))


def with_permutation(df: DataFrame, index: str, size: str, salt: list[str], seed: int, rounds: int = 2) -> DataFrame:
    """Replace ``index`` by a pseudorandom permutation of [0, size), for any size; ``salt`` columns choose it.

    Each round multiplies by a number coprime to the size, shifts, and rotates
    every row of an (almost) square layout by its own hashed amount, the last
    row by its own length: each step is a bijection, so no two indexes meet.
    The steps are columns of their own, so that none is computed twice.
    """
    n = F.col(size)
    factor = F.when(n % PRIMES[0] != 0, F.lit(PRIMES[0])).when(n % PRIMES[1] != 0, F.lit(PRIMES[1])).otherwise(1)
    df = df.withColumn("__f", factor.cast("long")).withColumn("__w", F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    for r in range(rounds):
        shift = F.pmod(F.xxhash64(F.lit(seed), *salt, F.lit(2 * r)), n)
        df = df.withColumn("__i", F.pmod(F.col(index) * F.col("__f") + shift, n))
        df = df.withColumn("__r", F.floor(F.col("__i") / F.col("__w")).cast("long"))
        df = df.withColumn("__l", F.least(F.col("__w"), n - F.col("__r") * F.col("__w")))
        turn = F.pmod(F.xxhash64(F.lit(seed), *salt, F.lit(2 * r + 1), "__r"), F.col("__l"))
        within = F.pmod(F.col("__i") - F.col("__r") * F.col("__w") + turn, F.col("__l"))
        df = df.withColumn(index, F.col("__r") * F.col("__w") + within)
    return df.drop("__f", "__w", "__i", "__r", "__l")


def _slots(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(sid, block, times): how often each block of each source is taken."""
    spark = sources.sparkSession
    wanted = sources.filter("source_size > 0").withColumn(
        "want", F.col("target") * F.col("blocks") / F.col("source_size"))
    n = wanted.agg(F.round(F.sum("want")).cast("long")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], "sid int, block long, times long")
    n_shards = -(-n // shard)
    # Shards are of two sizes, the last and the others: expected slots for each size.
    kinds = wanted.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "room", F.when(F.col("kind") == 0, F.lit(shard)).otherwise(F.lit(n - (n_shards - 1) * shard)))
    share = F.col("want") / F.sum("want").over(Window.partitionBy("kind"))
    kinds = kinds.withColumn("expected", share * F.col("room")).withColumn("sure", F.floor("expected").cast("long"))
    kinds = kinds.withColumn("part", F.col("expected") - F.col("sure"))
    whole, upto = Window.partitionBy("kind"), Window.partitionBy("kind").orderBy("sid")
    kinds = kinds.withColumn("left", F.col("room") - F.sum("sure").over(whole))
    high = F.sum("part").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("part").over(whole)
    kinds = kinds.withColumn("high", F.coalesce(high, F.lit(0.0)))
    kinds = kinds.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    kinds = checkpoint(kinds.withColumn(
        "high", F.when(F.col("high") == F.max("high").over(whole), F.lit(1.0)).otherwise(F.col("high"))))
    # Draws: uniform numbers, joined to the sources' intervals through the cells that they cover.
    shards = spark.range(n_shards).select(
        F.col("id").alias("shard"), F.when(F.col("id") < n_shards - 1, 0).otherwise(1).alias("kind"))
    left = kinds.groupBy("kind").agg(F.first("left").alias("left"))
    draws = shards.join(left, "kind").filter("left > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("left"))))
    draws = draws.withColumn(
        "u", F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(1 << 40)) / float(1 << 40))
    draws = draws.withColumn("cell", F.floor(F.col("u") * CELLS))
    cover = kinds.filter("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    drawn = draws.join(cover.select("kind", "cell", "sid", "low", "high"), ["kind", "cell"]).filter(
        "u >= low and u < high").groupBy("shard", "sid").agg(F.count("*").alias("extra"))
    fixed = shards.join(kinds.select("kind", "sid", "sure", "blocks"), "kind")
    counts = fixed.join(drawn, ["shard", "sid"], "left").select(
        "sid", "shard", "blocks", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("slots")).filter("slots > 0")
    counts = counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK_ROWS))
    placed = checkpoint(running_total(counts, ["sid"], "chunk", ["shard"], "slots", "first"))
    slot = placed.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)))
    slot = slot.select("sid", "blocks", "i").filter(F.col("i") < MAX_PASSES * F.col("blocks"))
    run = F.when(F.col("i") >= 2 * F.col("blocks"), 2).when(F.col("i") >= F.col("blocks"), 1).otherwise(0)
    slot = slot.select("sid", "blocks", run.alias("run"), (F.col("i") % F.col("blocks")).alias("block"))
    slot = with_permutation(slot, "block", "blocks", ["sid", "run"], seed)
    return slot.groupBy("sid", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS, shard: int = SHARD_SLOTS,
        chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(documents, pieces)`` of the mix.

    documents: one row per row of ``docs``: doc_id, text_hash, sid, off (first
    word in the source's stream), size, source, source_size, target, taken.
    pieces: the parts of documents that blocks cover: doc_id, text_hash, sid,
    off, start, words, times (0 to 3).

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own, the last; a null doc_id is an id; repeated rows count
    each time; an empty table gives no rows.  Columns other than doc_id, text
    and source are ignored.  Reruns give the same mix.
    """
    # A generated method above 8000 bytes is never compiled by the JVM; Spark then takes split expressions instead.
    docs.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    rows = checkpoint(docs.select(
        "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        word_count(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = checkpoint(source_targets(sizes).withColumn(
        "blocks", F.ceil(F.col("source_size") / block).cast("long")))
    placed = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    chunks = F.ceil(F.col("n_rows") / chunk_rows)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), chunks))
    # A source's order: chunks of hashed rows, inside a chunk by hash; equal rows may change places.
    placed = checkpoint(running_total(
        placed, ["sid"], "chunk", [F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text_hash", "size"], "size", "off"))
    end = F.col("off") + F.col("size")
    spans = placed.filter("size > 0").withColumn("block", F.explode(
        F.sequence(F.floor(F.col("off") / block), F.floor((end - 1) / block))))
    low = F.greatest(F.col("off"), F.col("block") * block)
    spans = spans.withColumn("start", low - F.col("off")).withColumn(
        "words", F.least(end, (F.col("block") + 1) * block) - low)
    times = _slots(sources, shard, seed)
    pieces = spans.select("doc_id", "text_hash", "sid", "off", "block", "start", "words").join(
        times, ["sid", "block"]).select("doc_id", "text_hash", "sid", "off", "start", "words", "times")
    sums = pieces.groupBy("sid", "off").agg(F.sum(F.col("words") * F.col("times")).alias("__taken"))
    known = placed.filter("size > 0").join(sums, ["sid", "off"], "left")
    cols = ["doc_id", "text_hash", "sid", "off", "size", "source", "source_size", "target"]
    documents = known.select(*cols, F.coalesce("__taken", F.lit(0)).alias("taken")).union(
        placed.filter("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))
    return documents, pieces


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents: for each pass over a document a row with the words taken in it.

    Columns are those of ``docs``, whatever their names; n_chars, where there
    is one, is counted anew.  Rows equal in doc_id and text stand for each
    other.  Null, empty and word-less texts are never taken; texts of any
    length are taken block by block; a null source is a source and a null
    doc_id an id; an empty table gives no rows.
    """
    _, pieces = mix(docs, seed)
    taken = pieces.groupBy("doc_id", "text_hash", "sid", "off").agg(
        F.array_sort(F.collect_list(F.struct("start", "words", "times"))).alias("p"),
        F.max("times").alias("m"))
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_h"), F.filter(
        "p", lambda p: p["times"] >= F.col("pass")).alias("p"))
    keyed = with_row(docs, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    once = keyed.filter(F.col("row.text").isNotNull()).dropDuplicates(["doc_id", "h"])
    out = once.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("h") == F.col("taken_h")))
    words = F.regexp_extract_all("row.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # explode of a one-element array keeps the words from being split anew for each piece.
    out = out.withColumn("w", F.explode(F.array(words))).withColumn("text", F.rtrim(F.concat_ws("", F.flatten(F.transform(
        "p", lambda p: F.slice("w", p["start"].cast("int") + 1, p["words"].cast("int")))))))
    return with_text(out.select("row", "text"), docs)

