"""What happens between retrieval and answering: floors, bands, context text, stored passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relevance floor, relevance bands, and the size of the context.
RELEVANCE_FLOOR = 0.50
BAND_HIGH = 70.0
BAND_MEDIUM = 50.0
MAX_PASSAGES = 10
MAX_PASSAGE_CHARS = 800
DEFAULT_SIMILARITY = 0.5

PASSAGE_SCHEMA = "array<struct<scripture:string,text:string,similarity:double,chunk_id:string>>"


def relevance_floor(hits: DataFrame, queries: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Hits at or above the floor; a query without any stays as one ``no_match`` row."""
    kept = hits.where(F.col("similarity") >= floor)
    return queries.select("qid").join(kept, "qid", "left").withColumn("no_match", F.col("similarity").isNull())


def relevance_band(pct: Column, high: float = BAND_HIGH, medium: float = BAND_MEDIUM) -> Column:
    return F.when(pct >= high, "high").when(pct >= medium, "medium").otherwise("low")


def shown_similarity(sim: Column) -> Column:
    """Similarity for display: a missing or zero value counts as one half."""
    return F.when(sim.isNull() | (sim == 0.0), DEFAULT_SIMILARITY).otherwise(sim)


def with_defaults(hits: DataFrame) -> DataFrame:
    """Fill what stored metadata may lack: name, text, chunk id, similarity."""
    return hits.select(
        "qid",
        "rank",
        F.coalesce("scripture", F.lit("Unknown")).alias("scripture"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("chunk_id"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def assemble_context(
    passages: DataFrame,
    questions: DataFrame,
    *,
    preamble: str = "Passages:\n\n",
    max_passages: int = MAX_PASSAGES,
    max_chars: int = MAX_PASSAGE_CHARS,
) -> DataFrame:
    """One prompt-ready text per question from its best passages, in rank order.

    Text is cut before it is shuffled, and at most ``max_passages`` rows meet per question.
    """
    line = F.concat(
        F.format_string("[Passage %d] ", F.col("rank")),
        F.col("scripture"),
        F.format_string(" (relevance: %.1f%%)\n", F.col("similarity") * 100.0),
        F.substring("text", 1, max_chars),
    )
    joined = (
        passages.where(F.col("rank") <= max_passages)
        .select("qid", F.struct("rank", line.alias("line")).alias("part"))
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
    )
    body = F.coalesce(F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n"), F.lit(""))
    return questions.join(joined, "qid", "left").select(
        "qid",
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_passages"),
        F.concat(F.lit(preamble), body, F.lit("\n\n---\n\nQuestion: "), F.col("question")).alias("context"),
    )


def source_diversity(passages: DataFrame) -> DataFrame:
    return passages.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_passages"), F.count_distinct("scripture").alias("n_sources")
    )


def encode_passages(passages: DataFrame) -> DataFrame:
    """``(qid, passages_json)``: the passages of an answer as one JSON array in rank order."""
    item = F.struct(
        "rank",
        "scripture",
        "text",
        F.round("similarity", 4).alias("similarity"),
        F.col("chunk_id").cast("string").alias("chunk_id"),
    )
    fields = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda p: F.struct(
            p["scripture"].alias("scripture"),
            p["text"].alias("text"),
            p["similarity"].alias("similarity"),
            p["chunk_id"].alias("chunk_id"),
        ),
    )
    return passages.groupBy("qid").agg(F.to_json(fields).alias("passages_json"))


def decode_passages(json_text: Column) -> Column:
    """Passages of a stored answer; null, blank or broken JSON is an empty list."""
    return F.coalesce(F.from_json(json_text, PASSAGE_SCHEMA), F.array().cast(PASSAGE_SCHEMA))
