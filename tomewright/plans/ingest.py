"""From raw files to a searchable index, with a table written after each costly stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.fixed_values import PAGE_MARKERS_B
from tomewright.functions.strings import once
from tomewright.functions.text import clean_text
from tomewright.functions.vectors import l2_normalize
from tomewright.operators import inverted_file as ivf
from tomewright.operators.chunk import chunk_documents
from tomewright.operators.context import assemble_context
from tomewright.operators.embed import EmbedFn, embed_texts, generate_answers
from tomewright.operators.topk import similarity_topk
from tomewright.sources import sinks
from tomewright.sources.files import read_books


def clean_books(spark: SparkSession, root: str, markers: list[str] = PAGE_MARKERS_B) -> DataFrame:
    docs = read_books(spark, root)
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, once(clean_text(F.col("text"), markers)).alias("text")).where(F.col("text") != "")


def build_index(
    spark: SparkSession, root: str, out: str, *, n_cells: int = 100, embed_fn: EmbedFn | None = None, max_words: int = 400
) -> None:
    """Clean, chunk, embed, normalise and index the corpus under ``root`` into tables under ``out``.

    Every table is read back before the next stage, so that a lost executor never repeats the embedding
    calls of an earlier stage. A vector's id is derived from its file and chunk number.
    """
    docs = clean_books(spark, root).select(F.col("book").alias("scripture"), "rel", "text")
    chunks = chunk_documents(docs, max_words=max_words).withColumn("vec_id", F.xxhash64("scripture", "rel", "chunk_id"))
    chunks.write.mode("overwrite").parquet(f"{out}/chunks")
    stored = spark.read.parquet(f"{out}/chunks")
    sinks.write_embeddings(l2_normalize(embed_texts(stored, "text", embed_fn), "embedding"), f"{out}/embeddings", True)
    vectors = spark.read.parquet(f"{out}/embeddings").select("vec_id", "scripture", "embedding")
    centroids = ivf.train_cells(vectors, "embedding", n_cells)
    sinks.write_index(ivf.nearest_cells(vectors, "embedding", centroids, 1), centroids, f"{out}/index")


def search_index(spark: SparkSession, out: str, queries: DataFrame, k: int = 5, n_probe: int = 10) -> DataFrame:
    """Top-k of a built index with name and text; text is read for the final hits only."""
    members, cells = sinks.read_index(spark, f"{out}/index")
    hits = ivf.probe_topk(members, queries, cells, k, n_probe)
    text = spark.read.parquet(f"{out}/chunks").select("vec_id", "scripture", "chunk_id", "text")
    return hits.join(text, "vec_id")


def seed_faq(questions: DataFrame, corpus: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """Answers to a fixed list of questions: exact top-k, context, answer, passages kept with it.

    ``questions``: (qid, question, qvec); ``corpus``: (vec_id, embedding); ``passages``: (vec_id,
    scripture, chunk_id, text).
    """
    hits = similarity_topk(corpus, questions, k).join(passages, "vec_id")
    answered = generate_answers(assemble_context(hits, questions))
    item = F.struct("rank", "scripture", "text", F.round("similarity", 4).alias("similarity"), F.col("chunk_id").cast("string").alias("chunk_id"))
    kept = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("passages"))
    return (
        questions.select("qid", "question").join(answered.select("qid", F.col("answer").alias("answer_text")), "qid")
        .join(kept, "qid", "left")
    )
