"""Registered round trips: whole tables go through a writer and come back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tomewright.catalog.tables import table
from tomewright.operators import stats
from tomewright.operators.ordered import ordered_parts
from tomewright.session import checkpoint_folder
from tomewright.sources import files, sinks


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/trip-{uuid.uuid4().hex}"


def embeddings_written(spark, d):
    """All labels are written unfinished, then those below 5 again as complete; the others stay as they are."""
    path = _folder(spark)
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("book"), "label").alias("scripture"), "label", "vec_id", "embedding")
    sinks.write_embeddings(rows, path, False)
    sinks.write_embeddings(rows.where("label < 5"), path, True)
    back = spark.read.parquet(path)
    return back.groupBy("scripture", "complete").agg(F.count("*").alias("n_vectors"), F.sum("vec_id").alias("sum_ids"))


def books_written(spark, d):
    """Each source's texts in order of ids as one book, cut into parts and written to a folder of its own."""
    path = _folder(spark)
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", "text")
    sinks.write_books(ordered_parts(docs, "book", "doc_id", "text", part_chars=50_000), path)
    return spark.read.parquet(path).select("book", "part", "n_texts", F.md5(F.col("text").cast("binary")).alias("digest"))


def letters_written(spark, d):
    """Orders as letters by year, unfinished ones without a date."""
    path = _folder(spark)
    undated = F.col("o_orderstatus") == "P"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    letters = table(spark, d, "orders").select(
        F.concat(F.lit("Customer "), "o_custkey").alias("recipient"), F.when(~undated, day).alias("date"),
        F.when(F.col("o_orderpriority").startswith("1"), "London").alias("location"), F.col("o_orderkey").cast("string").alias("url"),
        F.concat(F.lit("Dear sir,\n"), "o_orderpriority").alias("content"), F.when(~undated, F.substring(day, 1, 4)).alias("year"),
    )
    sinks.write_letters(letters, path)
    return spark.read.parquet(path).select("url", F.col("year").cast("string").alias("year"), "text")


def cost_log_written(spark, d):
    """Documents with even and odd ids are logged one after the other, as JSON and as CSV."""
    path = _folder(spark)
    docs = table(spark, d, "documents")
    for odd in (0, 1):
        sinks.append_cost_log(stats.cost_entries(docs.where(F.col("doc_id") % 2 == odd), "source", "text"), f"{path}/json", f"{path}/csv")
    shape = "date timestamp, scripture string, tokens bigint, estimated_cost_usd double, actual_cost_usd double"
    both = spark.read.schema(shape).json(f"{path}/json").withColumn("form", F.lit("json")).unionByName(
        spark.read.schema(shape).option("header", True).csv(f"{path}/csv").withColumn("form", F.lit("csv"))
    )
    return both.groupBy("form", "scripture").agg(
        F.count("*").alias("n_entries"), F.sum("tokens").alias("tokens"), F.round(F.sum("actual_cost_usd"), 4).alias("cost_usd")
    )


def history_written(spark, d):
    """User turns are asked questions, appended in two batches; every row gets an id of its own."""
    root = _folder(spark)
    turns = table(spark, d, "conversations").where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("user_id"), "turn", F.col("text").alias("question"), F.upper("text").alias("answer_text"),
        F.lit("text").alias("answer_mode"), F.lit(None).cast("string").alias("audio_id"), F.lit("[]").alias("passages_json"),
    )
    for late in (False, True):
        sinks.append_questions(turns.where((F.col("turn") >= 4) == late).drop("turn"), f"{root}/questions")
    back = files.read_store(spark, root, "questions")
    return back.groupBy("user_id").agg(
        F.count_distinct("id").alias("n_questions"), F.sum(F.length("question")).alias("n_chars"),
        F.count_if(F.col("answer_text") == F.upper("question")).alias("n_answered"), F.count("created_at").alias("n_stamped"),
    )


def waitlist_written(spark, d):
    """Every customer signs up, those of some nations twice."""
    root = _folder(spark)
    rows = table(spark, d, "customer").select(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"), F.col("c_custkey").cast("string").alias("user_id"), "c_nationkey")
    sinks.append_waitlist(rows.drop("c_nationkey"), f"{root}/waitlist")
    sinks.append_waitlist(rows.where("c_nationkey < 5").drop("c_nationkey"), f"{root}/waitlist")
    return files.read_store(spark, root, "waitlist").groupBy("email", "user_id").agg(F.count_distinct("id").alias("n_rows"))


def faq_written(spark, d):
    """Opening turns with the texts that follow as passages, written as FAQ entries and loaded by normalised question."""
    path = _folder(spark)
    turns = table(spark, d, "conversations")
    passages = turns.where("turn BETWEEN 1 AND 3").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("scripture"), "text"))).alias("p")
    )
    shown = F.transform("p", lambda x: F.struct(x["scripture"].alias("scripture"), x["text"].alias("text"), (x["turn"] / 4.0).alias("similarity"), x["turn"].cast("string").alias("chunk_id")))
    entries = turns.where("turn = 0").join(passages, "conv_id").select(
        F.concat(F.lit(" No "), "conv_id", F.lit(": "), "text").alias("question"), F.concat(F.lit("Answer\n"), "conv_id").alias("answer_text"), shown.alias("passages")
    )
    sinks.write_faq(entries, path)
    return files.load_faq(spark, path).select(
        "faq_key", "answer_text", F.size("passages").alias("n_passages"),
        F.aggregate("passages", F.lit(0.0), lambda s, p: s + p["similarity"]).alias("sum_similarity"),
        F.array_join(F.transform("passages", lambda p: p["chunk_id"]), ",").alias("chunk_ids"),
        F.md5(F.array_join(F.transform("passages", lambda p: p["text"]), "|").cast("binary")).alias("digest"),
    )


QUERIES = {
    f.__name__: f
    for f in (embeddings_written, books_written, letters_written, cost_log_written, history_written, waitlist_written, faq_written)
}

SQL = {
    "embeddings_written": """SELECT 'book' || label AS scripture, label < 5 AS complete, count(*) AS n_vectors, sum(vec_id)::BIGINT AS sum_ids
FROM embeddings GROUP BY ALL""",
    "books_written": """WITH p AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY source
  ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 50000 AS part FROM documents)
SELECT source AS book, part, count(*) AS n_texts, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM p GROUP BY ALL""",
    "letters_written": """SELECT o_orderkey::VARCHAR AS url, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y') END AS year,
  'LETTER TO: Customer ' || o_custkey || chr(10) || 'DATE: ' || CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  || chr(10) || 'LOCATION: ' || CASE WHEN o_orderpriority[1] = '1' THEN 'London' ELSE 'Unknown' END || chr(10) || 'URL: ' || o_orderkey
  || chr(10) || repeat('=', 70) || chr(10) || chr(10) || 'Dear sir,' || chr(10) || o_orderpriority AS text FROM orders""",
    "cost_log_written": """WITH e AS (SELECT source, length(text) // 4 AS tokens, round((length(text) // 4) / 1000000.0::DOUBLE * 0.12::DOUBLE, 4) AS cost FROM documents)
SELECT form, source AS scripture, count(*) AS n_entries, sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost_usd
FROM e CROSS JOIN (VALUES ('json'), ('csv')) f(form) GROUP BY ALL""",
    "history_written": """SELECT conv_id::VARCHAR AS user_id, count(*) AS n_questions, sum(length(text))::BIGINT AS n_chars, count(*) AS n_answered,
  count(*) AS n_stamped FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "waitlist_written": """SELECT lower(replace(c_name, '#', '.')) || '@example.org' AS email, c_custkey::VARCHAR AS user_id,
  CASE WHEN c_nationkey < 5 THEN 2 ELSE 1 END::BIGINT AS n_rows FROM customer""",
    "faq_written": """WITH p AS (SELECT conv_id, count(*) AS n, sum(turn / 4.0::DOUBLE) AS s, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS ids,
  md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY conv_id)
SELECT lower(trim(' No ' || conv_id || ': ' || text, ' ' || chr(9) || chr(10) || chr(13))) AS faq_key, 'Answer' || chr(10) || conv_id AS answer_text,
  n::INTEGER AS n_passages, s AS sum_similarity, ids AS chunk_ids, digest FROM conversations JOIN p USING (conv_id) WHERE turn = 0""",
}
