"""Corpus pipeline: from raw documents to token ids, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from tomewright.llm.common import stored, table, word_vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the classifier learns from the labelled ones among them."""
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, 0.8) the document with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark; ``n_chars`` follows the text."""
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number and digests."""
    return bpe.encode_documents(docs, word_vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL can express none of classifier, trie encoding or entropy windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
