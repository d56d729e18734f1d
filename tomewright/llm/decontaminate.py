"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import small_batches, stored

NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: First word of the template of a window that is compared word for word.
EXACT = "<exact>"

# Spelled numbers and units of measure that count as placeholders.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "km m cm mm mi mile miles foot feet ft inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons "
    "tonne tonnes l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp % percent degree "
    "degrees celsius fahrenheit kelvin v volt volts w watt watts kw j joule joules n newton newtons hz khz mhz mph km/h".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+|%)")
EDGES = "\"'`.,;:!?()[]{}<>|*&#@~^_=-/\\“”‘’«»¿¡…"

#: Bits of the window digest that make up the filter sent to the tasks.
FILTER_BITS = 20

WINDOW_SCHEMA = "doc_id bigint, pos int, template string, slots array<string>"

_PLAIN, _CAPITAL, _STOP, _SKIP, _GLUE, _SLOT = 0, 1, 2, 4, 8, 16


def _digest(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Tokens(dict):
    """Raw word -> row of the tables ``canon`` (canonical text), ``low`` (the word itself), their digests and ``flag``.

    Emptied between texts when it grows beyond ``keep`` words, which changes no result.
    """

    def __init__(self, keep: int = 300_000):
        super().__init__()
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.canon: list[str] = []
        self.low: list[str] = []
        self.code, self.low_code, self.flag = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)

    def __missing__(self, raw: str) -> int:
        core = raw.strip(EDGES)
        low = core.lower()
        flag = _PLAIN
        if not core:
            flag, canon = _SKIP, ""
        elif low in NUMBER_WORDS or NUMBER.fullmatch(core):
            flag, canon = _SLOT, NUM
        elif low in UNITS:
            flag, canon = _SLOT, UNIT
        else:
            canon = low
            found = GLUED.fullmatch(core) if core[0].isdigit() or core[0] in "+-$€£" else None
            if found and found[2].lower() in UNITS:
                flag |= _GLUE
            if core[0].isupper():
                flag |= _CAPITAL
        if raw[-1] in ".!?:…" or len(raw) > 1 and raw[-2] in ".!?":
            flag |= _STOP
        row = len(self.canon)
        if row == len(self.code):
            self.code, self.low_code, self.flag = (np.resize(a, 2 * row) for a in (self.code, self.low_code, self.flag))
        self.canon.append(canon)
        self.low.append(low)
        self.code[row], self.flag[row] = _digest(canon), flag
        self.low_code[row] = self.code[row] if canon == low else _digest(low)
        self[raw] = row
        return row


_NAME_CODE = np.uint64(_digest(NAME))
_EXACT_CODE = np.uint64(_digest(EXACT))
_BASE = _digest("base") | 1
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _spans(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of the stretches ``code[start:end]``: sums of code times a power, shifted back to the start."""
    n = len(code)
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BASE_BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * power[:n], out=total[1:])
    return (total[ends] - total[starts]) * back[starts]


class Found:
    """The words of one text, the starts and ends of its template windows and their digests."""

    def __init__(self, words, shown, rows, is_name, starts, ends, digests):
        self.words, self.shown, self.rows, self.is_name = words, shown, rows, is_name
        self.starts, self.ends, self.digests = starts, ends, digests


class Windows:
    """Template windows of whole texts.

    A window is the shortest stretch from its first word on with ``size`` words, ``concrete`` of them no
    placeholders; it is made longer, up to ``REACH`` times ``size`` words, until both hold. A capitalised word that
    does not open a sentence is a name. The first word of a window is never one, as what stands before it
    plays no part: a window's template follows from its words alone.
    """

    REACH = 8

    def __init__(self, size: int, concrete: int):
        self.size, self.concrete, self.tokens = size, concrete, Tokens()

    def of(self, text: str) -> Found | None:
        """None for a text without words."""
        tokens = self.tokens
        if len(tokens) > tokens.keep:
            tokens.reset()
        words = text.split()
        rows = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
        flags = tokens.flag[rows]
        if (flags & _GLUE).any():  # a number with its unit in one word: cut in two
            words = [w for word, f in zip(words, flags) for w in (self._cut(word) if f & _GLUE else (word,))]
            rows = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
            flags = tokens.flag[rows]
        shown = np.flatnonzero((flags & _SKIP) == 0)
        if not len(shown):
            return None
        stops = (flags & _STOP) != 0
        # Marks between two words (dropped here) end a sentence for the word behind them as well.
        ended = np.concatenate(([True], np.maximum.reduceat(stops, shown)[:-1]))
        rows, flags = rows[shown], flags[shown]
        is_name = ((flags & _CAPITAL) != 0) & ~ended
        plain = tokens.code[rows]
        code = np.where(is_name, _NAME_CODE, plain)
        n = len(rows)
        counts = ((flags & _SLOT) == 0) & ~is_name
        at = np.flatnonzero(counts)
        # A name that opens a window counts as concrete there, as any word but a number or a unit does.
        need = np.cumsum(counts) - counts + self.concrete - 1 - (is_name & ((flags & _SLOT) == 0))
        starts = np.flatnonzero(need < len(at))
        ends = np.maximum(at[need[starts]] + 1, starts + self.size)
        made = (ends <= n) & (ends - starts <= self.REACH * self.size)
        starts, ends = starts[made], ends[made]
        digests = _spans(code, starts, ends) + plain[starts] - code[starts]
        return Found(words, shown, rows, is_name, starts, ends, digests)

    def exact(self, found: Found, length: int) -> np.ndarray:
        """Digests of all stretches of ``length`` words, word for word."""
        starts = np.arange(max(0, len(found.rows) - length + 1))
        return _spans(self.tokens.low_code[found.rows], starts, starts + length) * _EXACT_CODE

    def exact_lengths(self, found: Found, enough: int, shortest: int) -> tuple[int, ...]:
        """Length of the exact windows of an item: none where it has ``enough`` templates or too few words."""
        n = len(found.rows)
        return (min(self.size, n),) if len(found.starts) < enough and n >= shortest else ()

    @staticmethod
    def _cut(word: str) -> tuple[str, str]:
        core = word.strip(EDGES)
        m = GLUED.fullmatch(core)
        at = word.index(core) + m.end(1)
        return word[:at], word[at:]

    def shown(self, found: Found, k: int) -> tuple[int, str, list[str]]:
        """Start, template and slot values (placeholder and word) of the window number ``k``."""
        first, parts, slots = int(found.starts[k]), [], []
        for j in range(first, int(found.ends[k])):
            canon = self.tokens.canon[found.rows[j]]
            if found.is_name[j] and j > first:
                canon = NAME
            parts.append(canon)
            if canon in (NUM, UNIT, NAME):
                slots.append(f"{canon}{found.words[found.shown[j]].strip(EDGES).lower()}")
        return first, " ".join(parts), slots

    def shown_exact(self, found: Found, first: int, length: int) -> tuple[int, str, list[str]]:
        return first, " ".join([EXACT, *(self.tokens.low[r] for r in found.rows[first : first + length])]), []


def _rows(found: list[tuple]) -> pa.RecordBatch:
    ids, pos, template, slots = zip(*found) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(template, pa.string()), pa.array(slots, pa.list_(pa.string()))],
        names=["doc_id", "pos", "template", "slots"],
    )


def template_windows(
    rows: DataFrame, key: str, text: str, size: int, concrete: int, filter_bits=None, lengths: tuple[int, ...] = (),
    enough: int = 0, shortest: int = 0,
) -> DataFrame:
    """(doc_id, pos, template, slots) of the windows of whole texts.

    With ``filter_bits`` (a broadcast bitmap) only windows whose digest falls on a set bit are made; a
    hash join on the template itself follows, so the filter never decides. Exact windows are made of the given
    ``lengths`` and, in texts with fewer than ``enough`` template windows, of ``size`` words or all there are.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size, concrete)
        bitmap = None if filter_bits is None else filter_bits.value

        def chosen(digests: np.ndarray):
            return range(len(digests)) if bitmap is None else np.flatnonzero(bitmap[digests >> np.uint64(64 - FILTER_BITS)])

        for batch in batches:
            out = []
            for key_value, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = windows.of(value.as_py() or "")
                if found is None:
                    continue
                made = [windows.shown(found, int(k)) for k in chosen(found.digests)]
                for length in lengths or windows.exact_lengths(found, enough, shortest):
                    made += [windows.shown_exact(found, int(k), length) for k in chosen(windows.exact(found, length))]
                out += [(key_value, *m) for m in made]
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return small_batches(rows.select(key, text)).mapInArrow(make, WINDOW_SCHEMA)


def _filter_bitmap(items: DataFrame, key: str, text: str, size: int, concrete: int, enough: int = 0, shortest: int = 0) -> np.ndarray:
    """Which digest prefixes the benchmark's windows have: at most 2**FILTER_BITS numbers, however large it is."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size, concrete)
        for batch in batches:
            seen: set[int] = set()
            for value in batch.column(0):
                found = windows.of(value.as_py() or "")
                if found is None:
                    continue
                exact = [windows.exact(found, n) for n in windows.exact_lengths(found, enough, shortest)]
                for digests in (found.digests, *exact):
                    seen.update((digests >> np.uint64(64 - FILTER_BITS)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["bucket"])

    got = items.select(text).mapInArrow(make, "bucket int").distinct().toArrow()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[got.column("bucket").to_numpy()] = True
    return bitmap


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, concrete: int = 6, enough: int = 6, shortest: int = 4,
    text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, n_slots, exact) of every document that holds a benchmark item.

    Windows of ``size`` words or more, ``concrete`` of them no placeholders, are joined on their template. A
    stretch of joined windows counts where its slots are consistent: equal benchmark values stand for equal
    document values and different ones for different ones; of an inconsistent stretch only the windows count
    that have the item's own values, and only if they are most of the item. A document leaks an item if a stretch has ``enough`` different windows of the
    item (all of them where the item has fewer). An item with fewer than ``enough`` template windows, as it is
    short or made of placeholders, is also looked for word for word, case and marks aside, in windows of ``size``
    words or, if it is shorter, as a whole. ``n_slots`` counts the placeholders of the stretch, ``exact`` says that
    one has no other values than the item. Items with fewer than ``shortest`` words and null texts have no
    windows; a row without an id is never reported. Several items on one stretch are all reported. Repeated
    rows count once; extra columns are ignored.

    Every document sees a bitmap of fixed size, so only windows that may match leave the tasks; both
    sides then meet in an ordinary join that Spark broadcasts or shuffles by measured size.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_bitmap(benchmark, item_key, text, size, concrete, enough, shortest))
    item_windows = template_windows(
        benchmark.where(F.col(item_key).isNotNull()), item_key, text, size, concrete, enough=enough, shortest=shortest
    )
    word_for_word = F.col("template").startswith(EXACT + " ").alias("word_for_word")
    items = stored(item_windows.select(
        F.col("doc_id").alias("item_id"), F.col("pos").alias("item_pos"), "template", F.col("slots").alias("item_slots"), word_for_word
    ).distinct())
    totals = items.groupBy("item_id", "word_for_word").agg(F.countDistinct("item_pos").alias("n_item_windows"))
    # At most ``size`` different numbers.
    n_words = items.where("word_for_word").select((F.size(F.split("template", " ")) - 1).alias("n")).distinct()
    lengths = tuple(sorted(r.n for r in n_words.collect()))
    held = template_windows(docs.where(F.col("doc_id").isNotNull()), "doc_id", text, size, concrete, bits, lengths)
    # Windows on one diagonal are one stretch of the item. Over all its windows one value on one side must
    # stand for one on the other.
    stretch = ["doc_id", "item_id", "word_for_word", "diagonal"]
    met = stored(held.join(items, "template").select(
        "doc_id", "item_id", "word_for_word", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos",
        F.arrays_zip("item_slots", "slots").alias("zipped"),
    ))
    same = F.forall("zipped", lambda z: z["item_slots"] == z["slots"])
    counted = (
        met.groupBy(*stretch, "item_pos").agg(F.max(same).alias("same"))
        .groupBy(*stretch).agg(F.count("*").alias("n_all"), F.count_if("same").alias("n_same"))
    )
    pairs = met.select(*stretch, F.explode("zipped").alias("z")).select(*stretch, F.col("z.item_slots").alias("asked"), F.col("z.slots").alias("found")).distinct()
    unequal = [pairs.groupBy(*stretch, side).count().where("count > 1").select(*stretch) for side in ("asked", "found")]
    mixed = unequal[0].unionByName(unequal[1]).distinct().withColumn("mixed", F.lit(True))
    slots = pairs.groupBy(*stretch).agg(F.count("*").alias("n_slots"), F.max(F.col("asked") != F.col("found")).alias("other_values"))
    return (
        counted.join(mixed, stretch, "left")
        .join(slots, stretch, "left")
        .join(totals, ["item_id", "word_for_word"])
        .withColumn("n_windows", F.when(F.col("mixed"), F.col("n_same")).otherwise(F.col("n_all")))
        .where(F.col("mixed").isNull() | (2 * F.col("n_same") > F.col("n_item_windows")))
        .where(F.col("n_windows") >= F.least(F.lit(enough), F.col("n_item_windows")))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n_windows").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"),
            F.min(F.coalesce("n_slots", F.lit(0))).alias("n_slots"), F.max(~F.coalesce("other_values", F.lit(False))).alias("exact"),
        )
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; columns unchanged."""
    leaking = find_leaks(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)
