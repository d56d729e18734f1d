"""Writers. Each goes through Spark's output committer, so readers never see a half-written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tomewright.operators.inverted_file import cell_balls
from tomewright.sources.binary import Float32Matrix

FILE_ROWS = 1_000_000


def write_books(parts: DataFrame, path: str, book: str = "book") -> None:
    """Per-book text from ``ordered_parts``: one folder per book, parts in order, as parquet.

    Range partitioning by (book, part) keeps neighbours together and cuts a large book over many files.
    """
    ordered = parts.repartitionByRange(F.col(book), F.col("part")).sortWithinPartitions(book, "part")
    ordered.write.mode("overwrite").partitionBy(book).parquet(path)


def write_embeddings(chunks: DataFrame, path: str, complete: bool) -> None:
    """Replace the written scriptures only, with their completion flag."""
    flagged = chunks.withColumn("complete", F.lit(complete))
    (
        flagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", FILE_ROWS).partitionBy("scripture").parquet(path)
    )


def write_letters(letters: DataFrame, path: str) -> None:
    """Letters by year; undated ones under ``unknown``. ``text`` gets the header lines of a letter file."""
    missing = F.lit("Unknown")
    head = F.concat(
        F.lit("LETTER TO: "), F.col("recipient"), F.lit("\nDATE: "), F.coalesce("date", missing), F.lit("\nLOCATION: "),
        F.coalesce("location", missing), F.lit("\nURL: "), F.col("url"), F.lit("\n" + "=" * 70 + "\n\n"), F.col("content"),
    )
    dated = letters.withColumn("year", F.coalesce("year", F.lit("unknown")))
    dated.withColumn("text", head).write.mode("append").partitionBy("year").parquet(path)


def append_cost_log(entries: DataFrame, json_path: str, csv_path: str) -> None:
    entries.write.mode("append").json(json_path)
    entries.write.mode("append").option("header", True).csv(csv_path)


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"id": F.expr("uuid()"), "created_at": F.current_timestamp()})


def append_questions(answers: DataFrame, path: str) -> None:
    """History rows ``(user_id, question, answer_text, answer_mode, audio_id, passages_json)``."""
    _stamped(answers).write.mode("append").parquet(path)


def append_waitlist(rows: DataFrame, path: str) -> None:
    """Waitlist rows ``(email, user_id)``; the same address may sign up twice."""
    _stamped(rows).write.mode("append").parquet(path)


def write_index(members: DataFrame, centroids: DataFrame, path: str) -> None:
    """Inverted file: ``cells`` with centre, radius and size, and ``vectors`` in one folder per cell.

    A cell is cut into slices of about ``FILE_ROWS`` rows by its size, so that a small cell is one file and one
    with very many vectors is written, and later read, by many tasks. The sizes, one row per cell, are
    written first and sent to the members, which are shuffled once, by cell and slice.
    """
    spark = members.sparkSession
    cell_balls(members, centroids).write.mode("overwrite").parquet(f"{path}/cells")
    sizes = spark.read.parquet(f"{path}/cells").select("cell", F.ceil(F.col("n_members") / FILE_ROWS).alias("__n"))
    spread = members.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("__n")))
    (
        spread.drop("__n").repartition("cell", "slice").write.mode("overwrite")
        .option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/vectors")
    )


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(members, cells)`` of a stored inverted file; ``cells`` serves as centroids and as balls."""
    cells = spark.read.parquet(f"{path}/cells")
    kept = spark.read.parquet(f"{path}/vectors").schema
    typed = StructType([StructField(f.name, LongType() if f.name == "cell" else f.dataType) for f in kept])
    return spark.read.schema(typed).parquet(f"{path}/vectors"), cells


def write_vector_files(vectors: DataFrame, path: str, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Raw float32 matrix in a new folder, rows in order of ids, a file for each range of them."""
    vectors.sparkSession.dataSource.register(Float32Matrix)
    ordered = vectors.repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.col(vec_col).cast("array<float>").alias("embedding"))
    ordered.write.format("float32_matrix").mode("append").option("dim", dim).save(path)


def write_faq(answers: DataFrame, path: str) -> None:
    """``(question, answer_text, passages)`` as JSON lines."""
    answers.select("question", "answer_text", "passages").write.mode("overwrite").json(path)
