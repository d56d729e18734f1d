"""Running sums and row numbers over a total order without sorting everything in one task.

The order column is cut at quantiles of the data into ranges of bounded size. Each range is summed by
itself, the small table of range totals is summed up, and every row adds the total of the ranges before
its own. This holds for one global order as well as inside groups of any size: a group that owns a
third of the rows is spread over as many ranges as it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.session import durable

# What stands before and after the number at the head of a chapter.
CHAPTER_HEAD = ("\n\n" + "=" * 60 + "\nCHAPTER ", "\n" + "=" * 60 + "\n\n")

RANGE_ROWS = 500_000
MAX_RANGES = 10_000


def range_bounds(df: DataFrame, order: Column, rows_per_range: int = RANGE_ROWS) -> list:
    """Quantile cut points of ``order``; none when all rows fit into one range.

    Only the cut points reach the driver. They become constants of the plan, so that both passes over
    the data (totals, rows) cut at the same places even after a task is lost and run again.
    """
    n = df.count()
    ranges = min(MAX_RANGES, math.ceil(n / rows_per_range))
    if ranges <= 1:
        return []
    at = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(order, at, max(10_000, 10 * ranges)).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def range_no(order: Column, bounds: list) -> Column:
    """Number of cut points at or below the value, found by halving."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    if len(bounds) <= 64:
        return pick(0, len(bounds))
    cuts = F.array(*[F.lit(b) for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        left = order < F.get(cuts, mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(left, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"))
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, whole, halve, lambda s: s["lo"])


def running_sum(
    df: DataFrame,
    value: Column,
    order: list[str],
    out: str,
    *,
    by: list[str] | None = None,
    before: bool = False,
    rows_per_range: int = RANGE_ROWS,
    bounds: list | None = None,
    costly: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to this one (``before``: excluding it).

    ``order[0]`` must be orderable by range; the remaining columns only break ties inside a range.
    ``bounds`` may come from a cheaper table with the same order values. ``costly`` input that needs
    more than one range is written out once, as totals and rows both read it.
    """
    by = by or []
    if bounds is None:
        bounds = range_bounds(df.select(*order), F.col(order[0]), rows_per_range)
    tagged = df.withColumn("__v", value).withColumn("__r", range_no(F.col(order[0]), bounds))
    if costly and bounds:
        tagged = durable(tagged)
    w = Window.partitionBy(*by, "__r").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    local = tagged.withColumn("__w", F.coalesce(F.sum("__v").over(frame), F.lit(0)))
    if not bounds:
        return local.withColumn(out, F.col("__w")).drop("__v", "__r", "__w")
    totals = tagged.groupBy(*by, "__r").agg(F.sum("__v").alias("__t"))
    over = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__r", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__o"))
    keys = [local[k].eqNullSafe(offsets[k]) for k in by] + [local["__r"] == offsets["__r"]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    joined = local.join(offsets, cond).select(local["*"], offsets["__o"])
    return joined.withColumn(out, F.col("__w") + F.col("__o")).drop("__v", "__r", "__w", "__o")


def row_index(df: DataFrame, order: list[str], out: str = "row_index", by: list[str] | None = None, **kw) -> DataFrame:
    """Zero-based position in the total order."""
    return running_sum(df, F.lit(1).cast("long"), order, out, by=by, before=True, **kw)


def shard_merge(df: DataFrame, shard: str, position: str, out: str = "chunk_id", **kw) -> DataFrame:
    """Union of shards renumbered from zero, shard by shard and by position inside each.

    The number of shards is small; their start offsets come from one count per shard.
    """
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        row_index(df, [position], out, by=[shard], **kw)
        .join(starts, shard)
        .withColumn(out, F.col(out) + F.col("__start"))
        .drop("__start")
    )


def with_chapter_heads(verses: DataFrame, by: list[str], chapter: str, order: str, text: str) -> DataFrame:
    """``verses`` whose first text (by ``order``) of each chapter begins with the chapter's head.

    The first places, one row for each chapter, are found by a minimum that tasks fold before the shuffle.
    """
    first = verses.groupBy(*by, chapter).agg(F.min(order).alias("__first"))
    head = F.concat(F.lit(CHAPTER_HEAD[0]), F.col(chapter).cast("string"), F.lit(CHAPTER_HEAD[1]))
    begins = F.col(order) == F.col("__first")
    return verses.join(first, [*by, chapter]).withColumn(text, F.when(begins, F.concat(head, text)).otherwise(F.col(text))).select(*verses.columns)


def ordered_parts(
    df: DataFrame, by: str, order: str, text: str, *, sep: str = "\n\n", part_chars: int = 1 << 20, **kw
) -> DataFrame:
    """The ordered concatenation of each group, cut between texts into parts of about ``part_chars``.

    Reading the parts of a group in order, joined by ``sep``, gives the whole text; a group of any size
    thus never has to fit into one row.
    """
    size = (F.length(text) + len(sep)).cast("long")
    placed = running_sum(df.select(by, order, text), size, [order], "__at", by=[by], before=True, **kw)
    part = F.floor(F.col("__at") / part_chars).cast("long")
    items = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return (
        placed.groupBy(by, part.alias("part"))
        .agg(items.alias("i"))
        .select(
            by, "part", F.size("i").cast("long").alias("n_texts"),
            F.array_join(F.transform("i", lambda x: x[text]), sep).alias("text"),
        )
    )
