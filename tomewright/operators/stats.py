"""Corpus, cost, media and outcome figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.numbers import py_round
from tomewright.functions.strings import CHARS_PER_TOKEN, embed_cost, token_estimate
from tomewright.operators.ordered import running_sum

# Separator of joined books, start budget and warning level, letter price, trim policy in
# milliseconds, gap between joined clips.
BOOK_SEPARATOR = 2
BUDGET_USD, LOW_BUDGET_USD = 10.0, 1.0
TOKENS_PER_BYTE, LETTER_USD_PER_1M = 0.25, 0.18
TRIM_MIN_MS, TRIM_SHORT_MS = 12 * 60_000, 15 * 60_000
TRIM_SHORT_SIDE_MS, TRIM_FULL_SIDE_MS = 3 * 60_000, 5 * 60_000
CLIP_GAP_MS = 500
MONEY_UNITS = 10_000


def corpus_stats(docs: DataFrame, book: str, text: str) -> DataFrame:
    """Files, characters of the joined book, tokens and embedding cost per book; books with text only."""
    some = F.count_if(F.length(text) > 0)
    chars = F.sum(F.length(text)) + BOOK_SEPARATOR * (some - 1)
    per = docs.groupBy(book).agg(some.alias("n_files"), chars.cast("long").alias("n_chars")).where(F.col("n_files") > 0)
    tokens = F.floor(F.col("n_chars") / CHARS_PER_TOKEN).cast("long")
    return per.withColumn("tokens", tokens).withColumn("cost_usd", embed_cost(F.col("tokens")))


def corpus_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("n_books"),
        F.sum("n_files").alias("n_files"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def running_budget(log: DataFrame, order: str, text: str, actual: str, budget: float = BUDGET_USD, **kw) -> DataFrame:
    """Cost per entry, total so far, budget left and a low-budget flag, in order of the log.

    An entry's cost is the stated one, or the rounded estimate where none (or zero) is stated.
    """
    estimate = py_round(embed_cost(token_estimate(F.col(text))), 4)
    cost = F.when(F.col(actual).isNull() | (F.col(actual) == 0.0), estimate).otherwise(py_round(F.col(actual), 4))
    entries = log.select(order, estimate.alias("estimated_usd"), cost.alias("cost_usd"))
    # Entries have four digits: ten-thousandths as whole numbers add up alike in any order.
    units = F.round(F.col("cost_usd") * MONEY_UNITS).cast("bigint")
    summed = running_sum(entries, units, [order], "__total", **kw)
    left = F.lit(round(budget * MONEY_UNITS)).cast("bigint") - F.col("__total")
    return summed.withColumns(
        {
            "total_usd": F.col("__total") / MONEY_UNITS, "remaining_usd": left / MONEY_UNITS,
            "low": left < round(LOW_BUDGET_USD * MONEY_UNITS),
        }
    ).drop("__total")


def cost_entries(docs: DataFrame, name: str, text: str, actual: Column | None = None) -> DataFrame:
    """Rows of the cost log for freshly embedded texts."""
    tokens = token_estimate(F.col(text))
    estimate = py_round(embed_cost(tokens), 4)
    paid = estimate if actual is None else F.when(actual.isNull() | (actual == 0.0), estimate).otherwise(actual)
    return docs.select(
        F.current_timestamp().alias("date"), F.col(name).alias("scripture"), tokens.alias("tokens"),
        estimate.alias("estimated_cost_usd"), paid.alias("actual_cost_usd"),
    )


def year_histogram(letters: DataFrame, year: str, text: str, top: int = 5) -> DataFrame:
    """Busiest years: count, bytes and embedding cost."""
    size = F.sum(F.octet_length(text)).cast("long")
    per = letters.where(F.col(year) != "unknown").groupBy(year).agg(F.count(F.lit(1)).alias("n"), size.alias("n_bytes"))
    cost = F.col("n_bytes") * TOKENS_PER_BYTE / 1_000_000 * LETTER_USD_PER_1M
    return per.withColumn("cost_usd", F.round(cost, 6)).orderBy(F.desc("n"), year).limit(top)


def outcome_rates(log: DataFrame, by: str, action: str, actions: list[str], success: list[str]) -> DataFrame:
    """Count per action and success rate (percent, one digit) per group."""
    counts = [F.count_if(F.col(action) == a).alias(f"n_{a}") for a in actions]
    rate = F.count_if(F.col(action).isin(success)) * 100.0 / F.count(F.lit(1))
    return log.groupBy(by).agg(*counts, py_round(rate, 1).alias("success_pct"))


def trim_plan(duration_ms: Column) -> dict[str, Column]:
    """What to cut from both ends of a recording, by its length."""
    side = (
        F.when(duration_ms < TRIM_MIN_MS, 0).when(duration_ms < TRIM_SHORT_MS, TRIM_SHORT_SIDE_MS).otherwise(TRIM_FULL_SIDE_MS)
    )

    def minutes(ms: Column) -> Column:
        return py_round(ms / 60_000.0, 1)

    return {
        "action": F.when(side == 0, "skipped").otherwise("trimmed"),
        "side_ms": side.cast("long"),
        "before_min": minutes(duration_ms),
        "after_min": minutes(duration_ms - 2 * side),
        "removed_min": minutes(2 * side),
    }


#: Cells of the seeded order whose totals are looked at before any row is ordered.
PREFIX_CELLS = 1 << 16


def prefix_until(clips: DataFrame, key: str, duration_ms: str, target_ms: int, seed: str | None = "42", **kw) -> DataFrame:
    """Clips in (seeded hash) order while the time collected before them is below the target.

    Every clip also takes the gap that follows it. Of a seeded order only the part before the target is sorted.
    """
    seeded = F.md5(F.concat(F.lit(seed or ""), F.col(key).cast("string")).cast("binary"))
    place = F.conv(F.substring(seeded, 1, 13), 16, 10).cast("double") if seed else F.col(key).cast("double")
    length = F.col(duration_ms) + CLIP_GAP_MS
    ordered = clips.select(key, duration_ms, place.alias("place"))
    if seed:
        ordered = before_target(ordered, F.floor(F.col("place") / (1 << 52) * PREFIX_CELLS), length, target_ms)
    summed = running_sum(ordered, length, ["place", key], "before_ms", before=True, **kw)
    return summed.where(F.col("before_ms") < target_ms).drop("place")


def before_target(rows: DataFrame, cell: Column, value: Column, target: int) -> DataFrame:
    """``rows`` of the cells in which the sum over all cells before is below ``target``.

    Cells are summed in the scan and their totals, one row each, in one small window, so only the rows that
    can come before the target are ordered. With a negative value sums may fall again and no cell is left out.
    """
    tagged = rows.withColumn("__cell", cell)
    totals = tagged.groupBy("__cell").agg(F.sum(value).alias("t"), F.min(value).alias("low"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = totals.withColumn("before", before).agg(F.max(F.when(F.col("before") < target, F.col("__cell"))).alias("last"), F.min("low").alias("low")).first()
    if found["last"] is None or (found["low"] or 0) < 0:
        return rows
    return tagged.where(F.col("__cell") <= found["last"]).drop("__cell")


# Recommended span of joined training audio, in hours.
MIN_HOURS, MAX_HOURS = 2.0, 3.5


def selection_summary(clips: DataFrame, duration_ms: str) -> DataFrame:
    """Clips taken, hours with the gaps between them, and whether that is too short or too long."""
    hours = (F.coalesce(F.sum(duration_ms), F.lit(0)) + CLIP_GAP_MS * F.greatest(F.count(F.lit(1)) - 1, F.lit(0))) / 3_600_000.0
    verdict = F.when(hours < MIN_HOURS, "short").when(hours > MAX_HOURS, "long").otherwise("ok")
    return clips.agg(F.count(F.lit(1)).alias("n_clips"), hours.alias("hours"), verdict.alias("verdict"))


def recent_entries(log: DataFrame, stamp: str, n: int = 5) -> DataFrame:
    """The last ``n`` entries of a log, newest first."""
    return log.orderBy(F.col(stamp).desc()).limit(n)


def year_report(letters: DataFrame, year: str) -> DataFrame:
    """Letters and years in all, and the first and last year; undated letters aside."""
    dated = letters.where(F.col(year) != "unknown")
    return dated.agg(
        F.count("*").alias("n_letters"), F.count_distinct(year).alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    )


def counts_and_total(items: DataFrame, by: str) -> DataFrame:
    """Number of items in each group, and of all items under the name ``all``."""
    counts = items.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("whole"))
    return counts.select(F.when(F.col("whole") == 1, "all").otherwise(F.col(by).cast("string")).alias(by), "n")
