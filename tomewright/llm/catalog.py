"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import (
    ann, bpe, conversation_tree, decontaminate, hamming_join, html_extract, license_scan, ngram_join, periodic_runs, quality,
    repeated_strings, secret_scan, url_filter,
)
from tomewright.llm.common import table, word_vocabulary

#: (host, path, verdict) rules of the URL query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, d, "documents"))


def op2_template_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_quality_votes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), word_vocabulary())


def op5_repeated_strings(spark: SparkSession, d: str) -> DataFrame:
    return repeated_strings.remove_repeats(table(spark, d, "documents"))


def op6_multi_index_hashing(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_license_dice(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, d, "documents"), license_scan.template_frame(spark, license_scan.TEMPLATES))


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, d, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op9_template_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, d, "pages"))


def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, d, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_conversation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return conversation_tree.prefix_nodes(conversation_tree.with_shared_heads(table(spark, d, "conversations")))


def op12_hamming_dedup(spark: SparkSession, d: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, d, "documents"))


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(table(spark, d, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(planted))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


_QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_template_decontamination, op3_quality_votes, op4_bpe_encode, op5_repeated_strings,
        op6_multi_index_hashing, op7_license_dice, op8_url_filter, op9_template_extraction, op10_secret_scan,
        op11_conversation_rollup, op12_hamming_dedup, op13_periodic_runs, pipeline,
    )
}

_SQL: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.jaccard_sql(),
    "op7_license_dice": license_scan.scan_sql(license_scan.TEMPLATES),
    "op11_conversation_rollup": conversation_tree.nodes_sql(),
    "op12_hamming_dedup": hamming_join.near_duplicates_sql(),
    "op8_url_filter": url_filter.judge_sql(URL_RULES),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
