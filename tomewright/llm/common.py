"""Readers and intermediate tables shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.session import checkpoint_folder


#: Ids (8 bytes each, 8 MB in all) that may be sent to every executor.
BROADCAST_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the public word BPE vocabulary, a parameter of the encoder."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to ``rows``.

    Rows hold whole texts, so Spark's default of 10,000 of them takes tens of megabytes in the JVM and again
    in each Python worker. Batches are cut when a query runs, so the setting stays lowered.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if not 0 < now <= rows:
        conf.set(name, str(rows))
    return df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs no recompute of what stands before. Parquet is compressed,
    which checkpoint files of rows are not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_ids(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, one column of distinct ids, written once, and marked for broadcast while there are at most ``most``.

    A join with few ids then leaves the texts of the other side where they are; with more, both sides are
    shuffled as Spark sees fit.
    """
    ids = stored(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)


def runs(batches, column: int = 0):
    """Record batches sorted by a 64-bit column, regrouped into one table per value of that column."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.Table] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        table_ = pa.Table.from_batches([batch])
        for start, end in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[start] != current:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            current = keys[start]
            held.append(table_.slice(start, end - start))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def block_keys(member, size, block_rows: int):
    """Pairs of chunks (i <= j) a member of a group of ``size`` rows meets the others in, as an array column.

    A group is dealt by hash into chunks of about ``block_rows`` rows; every pair of chunks is a block of
    its own, so a group with most rows becomes many tasks of bounded size. A group of one chunk is one block.
    """
    n = F.ceil(size / F.lit(block_rows)).cast("int")
    chunk = F.pmod(F.xxhash64(member, F.lit(17)), n).cast("int")
    return chunk, F.transform(
        F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j"))
    )
