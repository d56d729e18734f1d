"""Order-dependent decisions per key: sliding-window limiter and circuit breaker.

The rules live in two small step classes that the batch form below and the streaming form share. Both
forget: behind a pause longer than their memory nothing of the past counts but whether a breaker was open.
So the batch form cuts each key where a pause of that length holds no event and folds the pieces
in parallel, one streamed pass each, keeping only the state of the current piece. Where a breaker was open
at the end of a piece, the first decision of the next one says that it closed again.

A piece that never pauses is cut further, into parts of bounded size. All parts are folded at once from an
empty state; then those whose true first state, the last state of the part before, is another one are folded
again from it. On calm data the last state of a part hardly depends on its first, so the second round is
the last. Where states keep depending on each other (a limiter overloaded throughout), after ``ROUNDS``
rounds the rest of such a piece is folded once as one sorted stream in constant memory. Rows are exact always.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.operators.ordered import running_sum
from tomewright.session import durable

MICROS = 1_000_000

# Requests per window and the window; failures, their window and the recovery time.
RATE_LIMIT, RATE_WINDOW_S = 10, 60
BREAKER_FAILURES, BREAKER_WINDOW_S, BREAKER_RECOVERY_S = 3, 60, 300


class Limiter:
    """Admits up to ``limit`` requests per sliding window; state: times of admitted requests."""

    memory_of_open = False

    def __init__(self, limit: int = RATE_LIMIT, window_s: float = RATE_WINDOW_S):
        self.limit, self.window = limit, int(window_s * MICROS)
        self.memory = self.window

    def step(self, log: list[int], at: int, flag: bool) -> tuple[list[int], str]:
        log = [t for t in log if at - t <= self.window]
        if len(log) >= self.limit:
            return log, "rejected"
        return [*log, at], "accepted"


class Breaker:
    """Opens after repeated failures, blocks while open, closes by itself after the recovery time.

    State: the opening time (or -1), then the times of recent failures.
    """

    memory_of_open = True

    def __init__(
        self, failures: int = BREAKER_FAILURES, window_s: float = BREAKER_WINDOW_S, recovery_s: float = BREAKER_RECOVERY_S
    ):
        self.failures = failures
        self.window, self.recovery = int(window_s * MICROS), int(recovery_s * MICROS)
        self.memory = max(self.window, self.recovery)

    def step(self, state: list[int], at: int, flag: bool) -> tuple[list[int], str]:
        opened, recent = (state[0], state[1:]) if state else (-1, [])
        closed_again = opened >= 0 and at - opened >= self.recovery
        if closed_again:
            opened, recent = -1, []
        if opened >= 0:
            return [opened, *recent], "blocked"
        prefix = "closed_" if closed_again else ""
        if not flag:
            return [-1], prefix + "success"
        recent = [t for t in [*recent, at] if t >= at - self.window]
        if len(recent) >= self.failures:
            return [at, *recent], prefix + "opened"
        return [-1, *recent], prefix + "failure"


Step = Callable[[list[int], int, bool], tuple[list[int], str]]


class Machine(Protocol):
    """A step rule with the time after which it has forgotten everything but, perhaps, that it was open."""

    memory: int
    #: Whether being open outlasts ``memory``; the state then begins with the time of opening, or -1.
    memory_of_open: bool

    def step(self, state: list[int], at: int, flag: bool) -> tuple[list[int], str]: ...


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


#: Rows of a part, slots of time a machine's memory is cut into, and rounds of parallel folds.
PART_ROWS, SLOTS, ROUNDS = 200_000, 16, 4

_FOLDED = "k string, piece bigint, part bigint, at bigint, id bigint, decision string, first boolean, state array<bigint>"
_PLACE = ["k", "piece", "part"]


def _walk(machine: Machine):
    """Fold sorted rows of each part: a decision for each row, and a row with the last state of the part.

    A row without an id, first of its part, brings the state to begin with; without one it is empty.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, fresh, out = None, [], True, []

        def made():
            names = [*_PLACE, "at", "id", "decision", "first", "state"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            for k, piece, part, at, id_, flag, start in zip(*(b[c].to_pylist() for c in (*_PLACE, "at", "id", "flag", "start")), strict=True):
                if (k, piece, part) != current:
                    if current:
                        out.append((*current, None, None, None, False, state))
                    current, state, fresh = (k, piece, part), [], True
                if start is not None:
                    state = start
                    continue
                state, decision = machine.step(state, at, flag)
                out.append((*current, at, id_, decision, fresh, None))
                fresh = False
            yield made()
            out = []
        if current:
            out.append((*current, None, None, None, False, state))
            yield made()

    return fold


def _fold(rows: DataFrame, machine: Machine, starts: DataFrame | None = None, by: list[str] = _PLACE) -> DataFrame:
    rows = rows.withColumn("start", F.lit(None).cast("array<bigint>"))
    if starts is not None:
        blank = (F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("id"), F.lit(False).alias("flag"))
        rows = rows.unionByName(starts.select(*_PLACE, *blank, "start"))
    ordered = rows.repartition(*by).sortWithinPartitions(*_PLACE, F.col("start").isNull(), "at", "id")
    return ordered.mapInArrow(_walk(machine), _FOLDED)


def _settled(rows: DataFrame, machine: Machine, rounds: int, told: Callable[[int, int], None] | None) -> DataFrame:
    """Folded ``rows`` of many parts, each begun with the state its predecessor ended with."""
    folded = durable(_fold(rows, machine))
    begun = folded.where("state IS NOT NULL").select(*_PLACE, F.array().cast("array<bigint>").alias("start"))
    ends = folded.where("state IS NOT NULL").select(*_PLACE, "state")
    for turn in range(1, rounds + 1):
        carried = ends.select("k", "piece", (F.col("part") + 1).alias("part"), F.col("state").alias("carried"))
        wrong = durable(begun.join(carried, _PLACE).where("carried <> start").select(*_PLACE, F.col("carried").alias("start")))
        n = wrong.count()
        if told:
            told(turn, n)
        if not n:
            return folded
        if turn == rounds:  # from the first part that is still wrong, the rest of a piece is one stream
            first = wrong.groupBy("k", "piece").agg(F.min_by("start", "part").alias("start"), F.min("part").alias("from"))
            late = rows.join(first.select("k", "piece", "from"), ["k", "piece"]).where("part >= from")
            stream = late.select("k", "piece", F.col("from").alias("part"), "at", "id", "flag")
            again = _fold(stream, machine, first.select("k", "piece", F.col("from").alias("part"), "start"))
            kept = folded.join(first.select("k", "piece", "from"), ["k", "piece"], "left").where("from IS NULL OR part < from").drop("from")
            return durable(kept.unionByName(again))
        again = _fold(rows.join(wrong.select(*_PLACE), _PLACE, "left_semi"), machine, wrong)
        folded = durable(folded.join(wrong.select(*_PLACE), _PLACE, "left_anti").unionByName(again))
        begun = durable(begun.join(wrong.select(*_PLACE), _PLACE, "left_anti").unionByName(wrong))
        ends = folded.where("state IS NOT NULL").select(*_PLACE, "state")
    return folded


def keyed_decisions(
    df: DataFrame, machine: Machine, *, key: str, at: str, id_col: str, flag: str | None = None,
    part_rows: int | None = None, rounds: int | None = None, told: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """``(id, decision)`` for every row, taken in order of (``at``, ``id``) inside each key.

    ``at`` is in microseconds; ``flag`` marks failures. Parts hold whole slots of time, so one with very many events
    within a sixteenth of the machine's memory is longer than ``part_rows``. ``told`` hears of each round and
    the number of parts it has to fold again.
    """
    part_rows, rounds = part_rows or PART_ROWS, rounds or ROUNDS
    width = machine.memory // SLOTS + 1
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"),
        F.col(at).cast("long").alias("at"),
        F.col(id_col).cast("long").alias("id"),
        (F.col(flag) if flag else F.lit(False)).alias("flag"),
    ).withColumn("slot", F.floor(F.col("at") / width))
    # SLOTS empty slots between two active ones are a pause longer than the memory.
    by_time = Window.partitionBy("k").orderBy("slot")
    active = rows.groupBy("k", "slot").agg(F.count(F.lit(1)).alias("n"))
    paused = F.coalesce((F.col("slot") - F.lag("slot").over(by_time) > SLOTS).cast("long"), F.lit(0))
    pieces = active.withColumn("paused", paused).withColumn("piece", F.sum("paused").over(by_time))
    within = Window.partitionBy("k", "piece").orderBy("slot")
    before = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = pieces.select("k", "slot", "piece", F.floor(before / part_rows).alias("part"))
    dense = Window.partitionBy("k", "piece").orderBy("part")  # a slot of many rows skips numbers
    pieces = durable(parts.withColumn("part", (F.dense_rank().over(dense) - 1).cast("bigint")))
    many = not pieces.where("part > 0").isEmpty()
    placed = rows.join(pieces, ["k", "slot"]).select(*_PLACE, "at", "id", "flag")
    if many:
        placed = durable(placed)
        folded = _settled(placed, machine, rounds, told)
    else:
        folded = _fold(placed, machine)
    if machine.memory_of_open:
        folded = folded if many else durable(folded)
        last = folded.where("state IS NOT NULL").groupBy("k", "piece").agg(F.max_by("state", "part").alias("state"))
        was_open = last.where(F.col("state")[0] >= 0).select("k", (F.col("piece") + 1).alias("piece"), F.lit(True).alias("was_open"))
        folded = folded.join(was_open, ["k", "piece"], "left")
        reopened = F.col("first") & (F.col("part") == 0) & F.coalesce("was_open", F.lit(False))
        decision = F.when(reopened, F.concat(F.lit("closed_"), "decision")).otherwise(F.col("decision"))
    else:
        decision = F.col("decision")
    return folded.where("id IS NOT NULL OR decision IS NOT NULL").select(F.col("id").alias(id_col), decision.alias("decision"))


def quota_ledger(requests: DataFrame, *, by: list[str], order: list[str], quota: str, kept: str, **kw) -> DataFrame:
    """Charge, refund or refuse requests of each user in order.

    A request charges one unit if any is left and gives it back unless ``kept``. Every refunded request
    leaves the balance as it was, so the balance before a request is the quota less the kept requests
    before it, down to zero: a running count, not a loop.
    """
    spent = running_sum(requests, F.col(kept).cast("long"), order, "spent", by=by, before=True, **kw)
    left = F.greatest(F.col(quota) - F.col("spent"), F.lit(0)).cast("long")
    return (
        spent.withColumn(
            "decision", F.when(left == 0, "refused").when(F.col(kept), "charged").otherwise("refunded")
        )
        .withColumn("remaining", left - F.when((left > 0) & F.col(kept), 1).otherwise(0))
        .drop("spent")
    )
