"""Lookups that spare work: embedding cache, exact history, FAQ, recency-bounded answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.numbers import py_round
from tomewright.functions.strings import md5_key, norm_key, sqlite_key

# Answer cache threshold and size, FIFO job table size, price of one query embedding.
CACHE_SIMILARITY = 0.92
CACHE_ENTRIES = 1000
JOB_ENTRIES = 500
USD_PER_QUERY = 0.0012


def latest(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """Newest row per key. Merged map-side, so a key holding most rows costs one row per task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("__l")).select(*keys, "__l.*")


def _hash(text: str) -> Column:
    """Never null, so that joins add no null test that would work the digest out again."""
    return F.coalesce(md5_key(F.col(text)), F.lit(""))


def embedding_cache(log: DataFrame, text: str, stamp: str, keep: list[str]) -> DataFrame:
    """Cache table from a log of embedded texts: the last one written per normalised text."""
    keyed = log.where(F.col(text).isNotNull()).withColumn("query_hash", _hash(text))
    return latest(keyed, ["query_hash"], F.col(stamp), keep)


def cache_hits(queries: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    return queries.withColumn("query_hash", _hash(text)).join(cache, "query_hash")


def cache_misses(queries: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    return queries.withColumn("query_hash", _hash(text)).join(cache, "query_hash", "left_anti")


def cache_stats(log: DataFrame, text: str) -> DataFrame:
    """One row of reuse figures over a log of lookups; the first lookup of a text is a paid miss."""
    per_key = log.groupBy(md5_key(F.col(text)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    unique, total = F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return per_key.agg(unique.alias("u"), total.alias("t")).select(
        F.col("u").alias("unique_queries"),
        F.col("t").alias("accesses"),
        F.when(F.col("u") > 0, py_round(F.col("t") / F.col("u"), 2)).otherwise(0.0).alias("avg_accesses"),
        F.when(F.col("t") > 0, py_round((F.col("t") - F.col("u")) / F.col("t") * 100, 1)).otherwise(0.0).alias("hit_rate"),
        (F.col("t") - F.col("u")).alias("calls_saved"),
        py_round((F.col("t") - F.col("u")) * USD_PER_QUERY, 4).alias("cost_saved"),
    )


def _digest(key: Column) -> Column:
    """Stands for a whole text in joins, so that no text is shuffled as a key."""
    return F.coalesce(F.sha2(key.cast("binary"), 256), F.lit(""))


def history_index(history: DataFrame, user: str, question: str, stamp: str, keep: list[str]) -> DataFrame:
    """Latest answer per (user, stored key); the stored key folds ASCII letters and blanks only."""
    keyed = history.where(F.col(question).isNotNull()).withColumn("__key", _digest(sqlite_key(F.col(question))))
    return latest(keyed, [user, "__key"], F.col(stamp), keep)


def exact_hits(requests: DataFrame, index: DataFrame, user: str, question: str) -> DataFrame:
    """Requests with the latest answer to the very same question of the same user, in any mode."""
    return requests.withColumn("__key", _digest(norm_key(F.col(question)))).join(index, [user, "__key"], "left").drop("__key")


def faq_index(faq: DataFrame, question: str, stamp: str, keep: list[str]) -> DataFrame:
    return latest(faq.where(F.col(question).isNotNull()).withColumn("__key", _digest(norm_key(F.col(question)))), ["__key"], F.col(stamp), keep)


def faq_hits(requests: DataFrame, index: DataFrame, question: str) -> DataFrame:
    return requests.withColumn("__key", _digest(norm_key(F.col(question)))).join(index, "__key", "left").drop("__key")


def keep_most_recent(entries: DataFrame, stamp: str, tie: str, n: int = CACHE_ENTRIES) -> DataFrame:
    """The ``n`` entries used last; eviction order is oldest first, earliest row first on a tie.

    Batch rule: inside one batch no question can hit an answer made by an earlier one of that batch.
    """
    return entries.orderBy(F.col(stamp).desc(), F.col(tie).desc()).limit(n)


def keep_newest(entries: DataFrame, order: str, n: int = JOB_ENTRIES) -> DataFrame:
    """The ``n`` entries that came in last: first in, first out."""
    return entries.orderBy(F.col(order).desc()).limit(n)
