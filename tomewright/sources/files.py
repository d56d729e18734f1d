"""Readers of text corpora, chunk envelopes, vector blobs, FAQ files, stores and media folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.strings import norm_key
from tomewright.sources.binary import ChunkEnvelopes, Float32Matrix, envelope_files

FAQ = (
    "question string, answer_text string, passages array<struct<scripture:string, text:string, similarity:double, "
    "chunk_id:string>>"
)
STORES = {
    "users": "id string, google_id string, email string, name string, photo_url string, text_quota int, voice_quota int, "
    "created_at timestamp",
    "questions": "id string, user_id string, question string, answer_text string, answer_mode string, audio_id string, "
    "passages_json string, created_at timestamp",
    "answer_cache": "id string, question string, answer_text string, audio_id string, mode string, passages_json string, "
    "embedding_blob binary, created_at timestamp, last_used_at timestamp",
    "waitlist": "id string, email string, user_id string, created_at timestamp",
}


def file_path() -> Column:
    """Plain (not percent-encoded) path of the file a row was read from."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def _below(root: str) -> Column:
    """Path relative to ``root``."""
    folder = "/" + root.split("://", 1)[-1].strip("/") + "/"
    path = file_path()
    return F.substring(path, F.instr(path, folder) + F.lit(len(folder)), F.length(path))


def read_corpus(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``(path, rel, text)``: one row per file below ``root``; ``rel`` is the order key of a corpus."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return raw.select(file_path().alias("path"), _below(root).alias("rel"), F.col("value").alias("text"))


def read_books(spark: SparkSession, root: str) -> DataFrame:
    """Corpus with ``book``: the folder right below ``root``; loose files and dot-folders are left out."""
    docs = read_corpus(spark, root).withColumn("book", F.regexp_extract("rel", "^([^/]+)/", 1))
    return docs.where((F.col("book") != "") & ~F.col("book").startswith("."))


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Verses laid out as ``chapter_NN/v*.txt``: ``(chapter, verse, text)``; chapters 1 to 18."""
    shape = "^chapter_(\\d{2})/(v[^/]*)\\.txt$"
    docs = read_corpus(spark, root, "v*.txt").where(F.col("rel").rlike(shape))
    chapter = F.regexp_extract("rel", shape, 1).cast("int")
    return docs.select(
        chapter.alias("chapter"), F.regexp_extract("rel", shape, 2).alias("verse"), "text", "rel"
    ).where(F.col("chapter").between(1, 18))


def read_month_files(spark: SparkSession, root: str, first_year: int, last_year: int) -> DataFrame:
    """Month files ``YYYY/conversations_YYYY_mon.txt`` of a span of years; other years are not listed."""
    years = "{" + ",".join(str(y) for y in range(first_year, last_year + 1)) + "}"
    shape = "/(\\d{4})/conversations_(\\d{4})_([A-Za-z]+)\\.txt$"
    raw = spark.read.text(f"{root.rstrip('/')}/{years}/conversations_*.txt", wholetext=True)
    docs = raw.select(file_path().alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(shape))
    return docs.select(
        F.regexp_extract("path", shape, 1).cast("int").alias("year"), F.regexp_extract("path", shape, 3).alias("month"),
        "text", "path",
    )


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, on whatever file system they name."""
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def read_envelopes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Flat chunks of ``*_embeddings.json`` envelopes; a nameless one is called after its file.

    ``paths`` is a folder or a list of files. A file is one task that streams its chunks in batches, so an
    envelope may be larger than a worker's memory. A file that is no envelope fails the query by name.
    """
    files = envelope_files(paths) if isinstance(paths, str) else list(paths)
    spark.dataSource.register(ChunkEnvelopes)
    raw = spark.read.format("chunk_envelopes").option("paths", json.dumps(files)).load()
    stem = F.replace(F.regexp_extract("path", "([^/]+)\\.json$", 1), F.lit("_embeddings"), F.lit(""))
    return raw.withColumn("scripture", F.coalesce("scripture", stem))


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chunks of the shards that exist, with the shard's place in the list as ``shard``."""
    found = existing(spark, paths)
    if not found:
        raise FileNotFoundError("none of the shards exists")
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(paths))):
        rank = F.when(F.col("path").endswith(p.split("://", 1)[-1]), i).otherwise(rank)
    return read_envelopes(spark, found).withColumn("shard", rank)


def read_vector_file(spark: SparkSession, path: str, dim: int, **options: object) -> DataFrame:
    """``(vec_id, embedding)`` of a raw row-major float32 matrix; the row number is the id.

    A file, or a folder of them in the order of names, is read in byte ranges, one a task.
    """
    spark.dataSource.register(Float32Matrix)
    return spark.read.format("float32_matrix").option("dim", dim).options(**options).load(path)


def load_faq(spark: SparkSession, path: str) -> DataFrame:
    """FAQ entries by normalised question; of equal questions the last in the file counts.

    A file is one JSON array, or holds an entry a line as ``write_faq`` leaves them: its first line tells.
    """
    first = spark.read.text(path).where(F.trim("value") != "").head()
    rows = spark.read.schema(FAQ).json(path, multiLine=first is None or first["value"].lstrip().startswith("[")).withColumn("__n", F.monotonically_increasing_id())
    last = rows.groupBy(norm_key(F.col("question")).alias("faq_key")).agg(
        F.max_by(F.struct("question", "answer_text", "passages"), "__n").alias("e")
    )
    return last.select("faq_key", "e.*")


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the application tables, kept as parquet with a fixed schema."""
    return spark.read.schema(STORES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_store_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table from a database; times are stored there as ISO text."""
    raw = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    fields = [f.split() for f in STORES[name].split(", ")]
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def media_inventory(spark: SparkSession, root: str, globs: str = "*.mp3") -> DataFrame:
    """``(path, chapter, bytes)`` of media files; contents are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)
    chapter = F.regexp_extract("path", "/chapter_(\\d+)/", 1).try_cast("int")
    return raw.select("path", chapter.alias("chapter"), F.col("length").alias("bytes"))
