"""From raw documents to packed sequences: each stage works on what the one before kept.

Language identification drops documents in no known language; of near copies one stays; secrets are blanked out; sources are
mixed to target weights, by leaving out or repeating documents; the rest is cut and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeeper.llm import jaccard, language, mixing, packing, secrets
from rowkeeper.llm.common import table, workers_find_library
from rowkeeper.llm.queries import vocabulary_file
from rowkeeper.session import workspace

#: No SQL can say what the stages do; the tests compare them with plain Python.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the likelihoods are fitted on 500 rows of each labelled language."""
    workers_find_library(spark)
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    return language.documents_in_known_languages(docs, language.fit_likelihoods(labelled, per_language=500))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    workers_find_library(spark)
    return jaccard.one_of_each_component(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text replaced and the length brought up to date."""
    workers_find_library(spark)
    blanked = secrets.redact_secrets(docs, vocabulary_file("byte_bpe_50k.tiktoken"))
    return blanked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their place in sequences of 1,024 tokens."""
    workers_find_library(spark)
    return packing.pack_documents(docs, vocabulary_file("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = workspace(spark, f"stage-{at}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
