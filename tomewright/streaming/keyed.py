"""Streaming twins of the keyed decisions, incremental ingest and the bounded answer cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tomewright.functions.text import clean_text
from tomewright.operators.caches import CACHE_ENTRIES, keep_most_recent, latest
from tomewright.operators.stateful import MICROS, Step
from tomewright.sources import versions
from tomewright.sources.files import file_path

_DECISION = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("decision", T.StringType()),
    ]
)


class Quota:
    """Remaining units of one key; a request that is not kept gives its unit back at once."""

    def __init__(self, start: int):
        self.start = start

    def step(self, state: list[int], at: int, flag: bool) -> tuple[list[int], str]:
        left = state[0] if state else self.start
        if left <= 0:
            return [left], "refused"
        return ([left - 1], "charged") if flag else ([left], "refunded")


class _Decider(StatefulProcessor):
    """Applies one step rule per key and forgets a key that stayed idle for ``idle_ms``."""

    def __init__(self, step: Step, idle_ms: int | None):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "s array<bigint>, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        state = list(held[0]) if held is not None and held[0] is not None else []
        out = []
        for at, i, flag in zip(batch["at"].tolist(), batch["id"].tolist(), batch["flag"].tolist(), strict=True):
            state, decision = self.step(state, at, flag)
            out.append((str(key[0]), i, decision))
        last = int(batch["at"].iloc[-1])
        self.state.update((state, last))
        if self.idle_ms is not None:
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "id", "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.state.get()[1] // 1000 + self.idle_ms:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def decide_stream(
    events: DataFrame, step: Step, *, key: str, ts: str, id_col: str, flag: str | None = None,
    delay: str, idle_s: float | None = None,
) -> DataFrame:
    """``(key, id, decision)`` of a stream of events, each micro-batch in order of (``ts``, ``id``).

    ``ts`` is cast to a timestamp with zone, as watermarks need one. Events that come more than ``delay``
    behind the newest one are late: Spark leaves them out and counts them in the query's progress
    (``numRowsDroppedByWatermark``). ``idle_s`` (twice the window for the limiter) lets the store forget keys that can no
    longer influence a decision. Needs the RocksDB state store. A key's rows of one micro-batch meet in
    one call: bound the batch at the source (files or offsets per trigger).
    """
    rows = events.select(
        F.col(key).cast("string").alias("key"),
        F.col(ts).cast("timestamp").alias("seen"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(id_col).cast("long").alias("id"),
        (F.col(flag) if flag else F.lit(False)).alias("flag"),
    ).withWatermark("seen", delay)
    idle_ms = None if idle_s is None else int(idle_s * MICROS // 1000)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Decider(step, idle_ms), outputStructType=_DECISION, outputMode="Append", timeMode="EventTime"
    )


def latest_status_stream(jobs: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    """Last status per job id; write it in update mode."""
    return jobs.groupBy(key).agg(F.max_by(status, ts).alias(status), F.max(ts).alias(ts))


def ingest_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, markers: list[str], per_trigger: int = 1000):
    """Clean the text files that arrived since the last call and append them to ``out``; then stop."""
    files = (
        spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_trigger).format("text").load(root)
    )
    cleaned = files.select(file_path().alias("path"), clean_text(F.col("value"), markers).alias("text"))
    query = (
        cleaned.where(F.col("text") != "").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


#: Versions of the cache table that stay on disk: the current one and those a running reader or a replay may need.
CACHE_VERSIONS = 3


def cache_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written versions, ascending."""
    return versions.complete(spark, path)


def current_cache(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The version the pointer names or, with ``below``, the newest one older than that; None without any."""
    if below is not None:
        older = [n for n in versions.complete(spark, path) if n < below]
        return spark.read.parquet(versions.folder(path, older[-1])) if older else None
    n = versions.current(spark, path)
    return None if n is None else spark.read.parquet(versions.folder(path, n))


def merge_answers(batch: DataFrame, path: str, number: int, n: int = CACHE_ENTRIES) -> None:
    """Version ``number`` of the cache: the one before and ``batch``, each id once as used last, the ``n`` used last.

    A batch that is run again reads the same older version and writes the same one. Of the versions before,
    ``CACHE_VERSIONS`` less one stay; older ones are removed once the pointer names the new one.
    """
    spark = batch.sparkSession
    old = current_cache(spark, path, number)
    both = batch if old is None else old.unionByName(batch)
    newest = latest(both, ["id"], F.col("last_used_at"), [c for c in both.columns if c != "id"])
    keep_most_recent(newest, "last_used_at", "id", n).write.mode("overwrite").parquet(versions.folder(path, number))
    versions.point_to(spark, path, number)
    for old_number in [v for v in versions.complete(spark, path) if v <= number][:-CACHE_VERSIONS]:
        versions.remove(spark, versions.folder(path, old_number))


def maintain_answer_cache(answers: DataFrame, path: str, checkpoint: str, *, n: int = CACHE_ENTRIES):
    """Add new answers to the cache and keep the ``n`` used last; each micro-batch writes a new version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_answers(batch, path, batch_id, n)

    query = (
        answers.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
