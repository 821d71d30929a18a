"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.lattice_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, multiplier=64.0)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file (the same on every machine that runs Python)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.suffix_dedup import dedup_digest

    return dedup_digest(_table(spark, sf_dir, "documents"), length=400, keep="none")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.mixing import mix

    documents, _ = mix(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.packing import Capacity, pack_documents

    # Documents and attention take part in the choice; neither capacity can cost a sequence.
    capacity = Capacity(tokens=2048, documents=2048, attention=2048 ** 2)
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity)


def op6_pair_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.ngram_lm import score_texts, train_split

    return score_texts(_table(spark, sf_dir, "documents"), train_split())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.common import id_remainder
    from careops.llm.langid import fit_languages, predict_languages, train_split

    docs = _table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs, train_split()))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.common import scratch_path
    from careops.llm.token_files import read_tokens, write_tokens

    path = scratch_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return read_tokens(spark, path).withColumnRenamed("id", "doc_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.common import id_remainder
    from careops.llm.quality import fit_quality, score_quality, train_split

    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), train_split())
    return score_quality(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.bpe import encode_and_decode

    found = encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return found.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careops.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), most=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


# Every pair is compared; the operator may miss a few in a hundred of the pairs close to 0.9.
OP2_SQL = """
with recursive vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), usable as (
  select vec_id, e from vectors
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), least as (
  select a as vec_id, min(b) as component_id from reach group by a
), degree as (
  select a as vec_id, count(*) as n_links from links group by a
)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from least left join degree using (vec_id)
"""

OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id
  where a.vec_id % 20 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20"""

OP12_SQL = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents
), w as (
  select doc, lang, source, translate(u.term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as u(term)
), kept as (
  select lang, term from w group by lang, term having count(distinct doc) >= 10
), vocabulary as (
  select lang, count(*)::hugeint as v from kept group by lang
), groups as (
  select g.lang, g.source, coalesce(o.v, 0) as v
  from (select distinct lang, source from d) g left join vocabulary o on o.lang = g.lang
), c as (
  select w.lang, w.source, w.term, count(*)::hugeint as n
  from w join kept k on k.lang = w.lang and k.term = w.term group by all
), sizes as (
  select g.lang, g.source, g.v, coalesce(sum(c.n), 0)::hugeint as total
  from groups g left join c on c.lang = g.lang and c.source = g.source group by all
), shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) as p
  from sizes s join kept k on k.lang = s.lang
  left join c on c.lang = s.lang and c.source = s.source and c.term = k.term
), lang_shares as (
  select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as q
  from (
    select s.lang, s.term, sum(s.n)::hugeint as n, any_value(o.v) as v,
      (select sum(z.total) from sizes z where z.lang = s.lang)::hugeint as total
    from shares s join vocabulary o on o.lang = s.lang group by s.lang, s.term)
), pairs as (
  select a.lang, a.source, b.source as item, 'pair' as part,
    coalesce((
      select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))
      from shares x join shares y on y.lang = x.lang and y.term = x.term
      where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from groups a join groups b on b.lang = a.lang and b.source <> a.source
), terms as (
  select s.lang, s.source, s.term as item, 'term' as part, ((s.p - l.q) * (s.p - l.q)) // (s.p + l.q) as value
  from shares s join lang_shares l on l.lang = s.lang and l.term = s.term
  where s.n > 0 and s.p > l.q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select lang, source, part, item, value from pairs union all select lang, source, part, item, value from terms)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from ranked where part = 'pair' or rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """The queries that have SQL; the others are held against brute force in the tests."""
    return {"op2_lattice_near_dedup": OP2_SQL, "op3_exact_top_k": OP3_SQL, "op12_source_divergence": OP12_SQL}
