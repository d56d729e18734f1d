"""Periodic runs of words: a run-length grammar by recompression answers how far two places of a text agree.

Texts of similar length are laid side by side as one string of word numbers. Rounds of block compression
(equal neighbours become one symbol) and pair compression (a left symbol before a right one becomes one
symbol) shorten it until hardly more than one symbol of each text is left. A run of period q and length
L >= max(12, 2q) holds L - q places that equal the word q further on, so it covers a multiple of
max(12 - q, q): the harmonic grid. For each grid place whose word recurs q later, the grammar is asked how
far the match reaches to the right and, read from its other end, to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import small_batches

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Words laid into one string, and grid places asked about at once; a longer text is a string of its own.
STRING_WORDS = 400_000
ASKED = 1_000_000


class Level:
    """Symbols of a round; ``up`` leads to the symbol of the next round, ``down`` from there to its first part."""

    __slots__ = ("sym", "up", "down", "blocks")

    def __init__(self, sym: np.ndarray):
        self.sym, self.up, self.down, self.blocks = sym, None, None, False

    def shrink(self, first: np.ndarray, sym: np.ndarray, blocks: bool) -> Level:
        """The next round: symbols ``sym`` begin at the places where ``first`` holds."""
        self.up = (np.cumsum(first) - 1).astype(np.int32)
        self.down = np.append(np.flatnonzero(first), len(first)).astype(np.int32)
        self.blocks = blocks
        return Level(sym)

    def mirrored(self) -> Level:
        back = Level(self.sym[::-1])
        if self.up is not None:
            back.up = (len(self.down) - 2 - self.up)[::-1]
            back.down = (len(self.sym) - self.down)[::-1]
            back.blocks = self.blocks
        return back


def recompress(words: np.ndarray, bound: int, small: int) -> list[Level]:
    """Rounds of a string whose symbols from ``bound`` on separate texts, until ``small`` symbols are left.

    A symbol keeps its number in later rounds, so equal numbers mean equal words at every round.
    Separators are all different and take no part in pairs.
    """
    levels = [Level(words.astype(np.int64))]
    fresh = int(words.max()) + 1
    seps = (bound, fresh)
    for turn in range(200):
        last = levels[-1]
        sym = last.sym
        if len(sym) <= small:
            break
        first = np.append(True, sym[1:] != sym[:-1])
        if not first.all():
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(sym)))
            new = sym[at]
            many = count > 1
            _, named = np.unique(new[many] << np.int64(32) | count[many], return_inverse=True)
            new[many] = fresh + named
            fresh += int(named.max()) + 1
            levels.append(last.shrink(first, new, True))
            last, sym = levels[-1], new
        plain = (sym < seps[0]) | (sym >= seps[1])
        left = ((sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & (1 << 64) - 1) >> np.uint64(61)) & np.uint64(1) == 1
        pair = np.append(left[:-1] & ~left[1:] & plain[:-1] & plain[1:], False)
        at = np.flatnonzero(pair)
        if not len(at):
            continue
        _, named = np.unique(sym[at] << np.int64(32) | sym[at + 1], return_inverse=True)
        first = np.ones(len(sym), bool)
        first[at + 1] = False
        new = sym.copy()
        new[at] = fresh + named
        fresh += int(named.max()) + 1
        levels.append(last.shrink(first, new[first], False))
    return levels


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of different places, the number of equal symbols from there on.

    Upwards: while the symbols at both places are equal, step over what the next round cuts differently
    (at most one symbol, or the shorter rest of a block) and climb. Where they differ, descend: at each
    round the first parts may still be equal.
    """
    a, b = i.astype(np.int64), j.astype(np.int64)
    stop = np.zeros(len(a), np.int32)
    alive = np.arange(len(a))
    top = len(levels) - 1
    for k, level in enumerate(levels):
        x, y = a[alive], b[alive]
        equal = level.sym[x] == level.sym[y]
        stop[alive[~equal]] = k
        alive, x, y = alive[equal], x[equal], y[equal]
        if not len(alive):
            break
        if k == top:
            stop[alive] = top
            while len(alive):
                a[alive] += 1
                b[alive] += 1
                alive = alive[level.sym[a[alive]] == level.sym[b[alive]]]
            break
        ux, uy = level.up[x], level.up[y]
        cut = (level.down[ux] != x) | (level.down[uy] != y)
        if cut.any():
            if level.blocks:
                rx, ry = level.down[ux + 1] - x, level.down[uy + 1] - y
                step = np.where(cut, np.minimum(rx, ry), 0)
                x, y = x + step, y + step
                apart = cut & (rx != ry)
                a[alive], b[alive] = x, y
                stop[alive[apart]] = k
                alive, x, y = alive[~apart], x[~apart], y[~apart]
            else:
                x, y = x + cut, y + cut
        a[alive], b[alive] = level.up[x], level.up[y]
    low = np.zeros(0, np.int64)
    for k in range(top, 0, -1):
        low = np.append(low, np.flatnonzero(stop == k))
        if not len(low):
            continue
        below = levels[k - 1]
        u, v = a[low], b[low]
        x, y = below.down[u].astype(np.int64), below.down[v].astype(np.int64)
        equal = below.sym[x] == below.sym[y]
        if below.blocks:
            step = np.minimum(below.down[u + 1] - x, below.down[v + 1] - y) * equal
        else:
            step = equal.astype(np.int64)
        a[low], b[low] = x + step, y + step
    return a - i


def _string_runs(string: np.ndarray, text_no: np.ndarray, bound: int, longest: int, least: int) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs, ordered, as places of the string."""
    forward = recompress(string, bound, 2 * int(text_no[-1]) + 3)
    backward = [level.mirrored() for level in forward]
    n = len(string)
    flat = string.astype(np.int32)
    found = np.zeros((0, 3), np.int64)
    held, periods, count = [], [], 0

    def ask(found: np.ndarray) -> np.ndarray:
        i, q = np.concatenate(held), np.concatenate(periods)
        right = agreement(forward, i, i + q)
        left = agreement(backward, n - i, n - i - q)
        long = right + left >= np.maximum(least - q, q)
        i, q, right, left = i[long], q[long], right[long], left[long]
        rows = np.concatenate([found, np.stack([i - left, i + q + right, q], 1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows

    for q in range(1, longest // 2 + 1):
        grid = max(least - q, q)
        i = np.flatnonzero(flat[: n - q : grid] == flat[q::grid]) * grid
        if not len(i):
            continue
        i = i[text_no[i] == text_no[i + q]]
        held.append(i)
        periods.append(np.full(len(i), q, np.int64))
        count += len(i)
        if count >= ASKED:
            found = ask(found)
            held, periods, count = [], [], 0
    return ask(found) if count else found


def text_runs(texts: list[list[int]], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, smallest period) of the runs of each text (a list of word numbers), by start and period.

    A run is a stretch with a smallest period q and a length of at least max(``least``, 2q) that no
    neighbouring word extends.
    """
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    order = sorted((t for t in range(len(texts)) if len(texts[t]) >= least), key=lambda t: len(texts[t]))
    at = 0
    while at < len(order):
        group, words, shortest = [], 0, len(texts[order[at]])
        while at < len(order) and (not group or words < STRING_WORDS and len(texts[order[at]]) <= 2 * shortest):
            group.append(order[at])
            words += len(texts[order[at]])
            at += 1
        sizes = np.array([len(texts[t]) for t in group])
        bound = 1 + max(int(np.max(texts[t])) for t in group)
        starts = np.cumsum(np.append(1, sizes + 1))
        string = np.empty(starts[-1], np.int64)
        text_no = np.empty(len(string), np.int32)
        string[0], text_no[0] = bound, 0
        for k, t in enumerate(group):
            string[starts[k] : starts[k] + sizes[k]] = texts[t]
            string[starts[k] + sizes[k]] = bound + k + 1
            text_no[starts[k] : starts[k + 1]] = k
        runs = _string_runs(string, text_no, bound, int(sizes.max()), least)
        if not len(runs):
            continue
        owner = text_no[runs[:, 0]]
        rows = np.stack([runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
        rows, owner = rows[order_ := np.lexsort((rows[:, 2], rows[:, 0], owner))], owner[order_]
        edges = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, t in enumerate(group):
            out[t] = rows[edges[k] : edges[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: those within a run after its first period go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, least: int = 12, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    Words are what stands between blanks and the control characters 9 to 13. ``runs`` lists every maximal
    stretch of words with a smallest period q and a length of at least max(``least``, 2q) as (start,
    length, period), ordered by start and period. ``collapsed`` holds the words that stand in no run or
    in the first period of all runs they stand in, joined by one blank.

    Each row is judged by itself: nothing is shuffled. A null or empty text has no words, no runs and an
    empty ``collapsed``; rows with the same or a null id stay rows of their own; extra columns are
    ignored. Texts of any length are taken whole; one long text is one string of the grammar.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        for batch in batches:
            if len(codes) > 300_000:
                codes.clear()
            words = [(value.as_py() or b"").split() for value in batch.column(1).cast(pa.binary())]
            numbers = [np.fromiter((codes.setdefault(w, len(codes)) for w in row), np.int64, len(row)) for row in words]
            every, collapsed = text_runs(numbers, least), []
            for row, runs in zip(words, every):
                if len(runs):
                    row = [row[k] for k in np.flatnonzero(kept_words(len(row), runs))]
                collapsed.append(b" ".join(row))
            flat = np.concatenate(every) if every else np.zeros((0, 3), np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, every)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_RUN)),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(row) for row in words], pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return small_batches(docs.select(F.col("doc_id").cast("bigint"), text)).mapInArrow(make, RUNS)


def with_planted_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) where texts whose id asks for it repeat a stretch of their own words to the end.

    h is the crc32 of the id in decimal digits and g = floor(h / 10). Where h ends in 0, the n words from
    a = g % n on repeat with the period 1 + floor((n - a) / (3 + g % 8)). A null id asks for nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    asked = docs.select("doc_id", F.col(text).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("bigint")
    asked = asked.withColumn("a", F.when(n > 0, F.col("g") % n))
    asked = asked.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.get(F.col("w"), F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")),
    )
    return asked.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of ``find_runs``' rows."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.withColumn("best", best)
    length, period = F.col("best.l"), -F.col("best.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
