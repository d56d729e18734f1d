"""Table maintenance without a table format: upsert, conditional update, paging, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quotas of a new user.
TEXT_QUOTA, VOICE_QUOTA = 5, 2


def upsert(target: DataFrame, source: DataFrame, key: str, updated: list[str], inserted: dict[str, Column]) -> DataFrame:
    """Take ``updated`` columns from the source where the key occurs there, keep all else; new keys get
    the ``inserted`` defaults. ``source`` holds one row per key."""
    t, s = target.alias("t"), source.withColumn("__in", F.lit(True)).alias("s")
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c in updated:
            out.append(F.when(F.col("__in"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            default = inserted.get(c, F.lit(None))
            out.append(F.when(F.col(f"t.{key}").isNull(), default).otherwise(F.col(f"t.{c}")).alias(c))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*out)


def reset_quota(users: DataFrame, resets: DataFrame, on: str, text: int = TEXT_QUOTA, voice: int = VOICE_QUOTA) -> DataFrame:
    """Set both quotas back for every user listed in ``resets`` and report who was updated."""
    listed = resets.select(on).distinct().withColumn("updated", F.lit(True))
    j = users.join(listed, on, "left").withColumn("updated", F.coalesce("updated", F.lit(False)))
    return j.withColumn("text_quota", F.when(F.col("updated"), text).otherwise(F.col("text_quota"))).withColumn(
        "voice_quota", F.when(F.col("updated"), voice).otherwise(F.col("voice_quota"))
    )


def quota_gate(requests: DataFrame, users: DataFrame, user: str, mode: str) -> DataFrame:
    """Add ``remaining`` and ``used`` units of the request's mode; an unknown user has none left."""
    left = users.select(user, F.col("text_quota").alias("__t"), F.col("voice_quota").alias("__v"))
    text = F.col(mode) == "text"
    remaining = F.coalesce(F.when(text, F.col("__t")).otherwise(F.col("__v")), F.lit(0))
    full = F.when(text, TEXT_QUOTA).otherwise(VOICE_QUOTA)
    return requests.join(left, user, "left").withColumns({"remaining": remaining, "used": full - remaining}).drop("__t", "__v")


def history_page(history: DataFrame, user: str, stamp: str, tie: str, limit: int, offset: int) -> DataFrame:
    """One page per user, newest first, with the user's total.

    The rank limit is applied before and after the shuffle, the total is a separate map-side count:
    a user with a third of all rows sends only ``offset + limit`` rows per task.
    """
    newest = Window.partitionBy(user).orderBy(F.col(stamp).desc(), F.col(tie).desc())
    page = history.withColumn("position", F.row_number().over(newest).cast("long")).where(
        F.col("position") <= offset + limit
    )
    totals = history.groupBy(user).agg(F.count(F.lit(1)).alias("total"))
    return page.where(F.col("position") > offset).join(totals, user)


def pending(work: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return work.join(done.select(on), on, "left_anti")


def resume(chunks: DataFrame, progress: DataFrame, on: str, position: str) -> DataFrame:
    """Chunks not yet embedded: from ``done`` on, none of a ``complete`` group, all of an unknown one."""
    j = chunks.join(progress.select(on, "done", "complete"), on, "left")
    todo = ~F.coalesce("complete", F.lit(False)) & (F.col(position) >= F.coalesce("done", F.lit(0)))
    return j.where(todo).drop("done", "complete")


def batch_plan(chunks: DataFrame, by: str, position: str, size: int = 50, every: int = 50) -> DataFrame:
    """Batches of each group with their row count and whether a checkpoint follows (each nth, and last)."""
    batches = chunks.groupBy(by, F.floor(F.col(position) / size).cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_chunks")
    )
    last = batches.groupBy(by).agg(F.max("batch").alias("last"))
    return batches.join(last, by).select(
        by, "batch", "n_chunks", (((F.col("batch") + 1) % every == 0) | (F.col("batch") == F.col("last"))).alias("checkpoint")
    )


def spine_counts(items: DataFrame, on: str, first: int, last: int, size: str) -> DataFrame:
    """Count and size for every number of the spine, zero where nothing exists, and the share covered."""
    per = items.groupBy(F.col(on).cast("long").alias(on)).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(size).alias("size")
    )
    spine = items.sparkSession.range(first, last + 1).select(F.col("id").alias(on))
    dense = spine.join(per, on, "left").select(
        on, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("size", F.lit(0)).cast("long").alias("size")
    )
    filled = F.count_if(F.col("n_items") > 0).over(Window.partitionBy(F.lit(0)))  # over the spine alone
    return dense.withColumn("n_filled", filled).withColumn(
        "complete_pct", F.round(F.col("n_filled") * 100.0 / (last - first + 1), 2)
    )


def accumulate(known: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """Keys known so far and those that come new, each once."""
    return known.select(on).unionByName(new.select(on)).distinct()
