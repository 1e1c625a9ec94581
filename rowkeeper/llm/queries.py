"""The registered queries of these operators; each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeeper.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score
  FROM usable q, usable x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op1_top_k_search", TOP_K_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.topk import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.secrets import secret_scan

    return secret_scan(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.tokens import token_counts

    return token_counts(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), limit=512)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, source IS NULL AS none, coalesce(source, '') AS name,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3]::DOUBLE AS weight
  FROM sources
), capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM placed
), levels AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM capped
  WINDOW before AS (ORDER BY ratio, none, encode(name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT min(level) FILTER (ratio > level) AS share
  FROM (SELECT *, row_number() OVER (ORDER BY ratio > level DESC, ratio, none, encode(name)) AS place FROM levels) WHERE place = 1
), targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE share * weight END AS target FROM levels, shared
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.mixing import mix_plan

    planned = mix_plan(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op9_document_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.merkle import edit_fingerprints

    return edit_fingerprints(table(spark, folder, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), size=1024, end_id=2)


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.jaccard import similarity_components

    return similarity_components(table(spark, folder, "documents"), width=4, percent=85)


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.substrings import remove_repeats

    cut = remove_repeats(table(spark, folder, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def language_model(spark: SparkSession, folder: str):
    from rowkeeper.llm.language import fit_likelihoods

    labelled = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return fit_likelihoods(labelled, per_language=500)


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Documents come from a source, which is their host; nothing declares their language."""
    from rowkeeper.llm.language import language_scores

    docs = table(spark, folder, "documents")
    return language_scores(docs, language_model(spark, folder), ["doc_id"], F.col("text"), host=F.col("source"))


@query("page_language_id")
def page_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Pages have all the evidence: text, declared language, address suffix, host and site."""
    from rowkeeper.llm.language import language_scores, page_host, page_language, page_text

    pages = table(spark, folder, "pages")
    html = F.col("html")
    return language_scores(
        pages, language_model(spark, folder), ["page_id"], page_text(html), host=page_host(F.col("url")),
        declared=page_language(html),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.repair import damaged, repair_conversations

    return repair_conversations(*damaged(table(spark, folder, "conversations")))


@query("op12_conversation_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.trie import conversation_trie

    return conversation_trie(table(spark, folder, "conversations"))


@query("op11_page_text")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from rowkeeper.llm.wrapper import page_texts

    return page_texts(table(spark, folder, "pages"))
