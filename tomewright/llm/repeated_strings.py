"""Exact removal of repeated byte strings: anchored shards, merged by iterative interleave refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import block_keys, runs, small_batches, stored

#: Bytes of an anchor: every string of the length sought holds one, chosen by its content alone.
ANCHOR = 40

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16
_POWERS = np.cumprod(np.full(_STEP, 0xD6E8FEB86659FD93, np.uint64))  # odd, so it has an inverse modulo 2**64
_INVERSE = np.cumprod(np.full(_STEP, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))


def gram_hashes(data: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """64-bit hash of every k-byte string, from prefix sums of a polynomial, a stretch at a time."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    room = _STEP - k
    for at in range(0, n, room):
        part = data[at : at + room + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _POWERS[: len(part)])))
        m = len(part) - k + 1
        out[at : at + m] = (sums[k:] - sums[:m]) * _INVERSE[:m]
    out ^= out >> np.uint64(31)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest hash (upper 32 bits) in every window of ``w`` hashes.

    Which one it is follows from the window's bytes alone. Hash and place share a number, so that running
    minima from both ends of fixed stretches give all windows in three passes.
    """
    n = len(h) - w + 1
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    blocks = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts, anchor offset) of the runs of strings with a common anchor.

    The strings of ``length`` bytes that start at ``first .. first + number - 1`` all chose the anchor that
    lies ``offset`` bytes behind the first start. Equal strings choose equal anchors at equal distance.
    """
    h = gram_hashes(np.frombuffer(data, np.uint8))
    places = window_minima(h, length - ANCHOR + 1)
    cuts = np.flatnonzero(places[1:] != places[:-1]) + 1
    first = np.concatenate((np.zeros(1, np.int64), cuts))
    number = np.diff(np.concatenate((first, [len(places)])))
    return h[places[first]], first, number, places[first] - first


def text_id(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


OCCURRENCES = "anchor bigint, seg bigint, tid bigint, place bigint"


def occurrences(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Every segment of every text: hashes of its anchor and of its bytes, its text and place.

    ``place`` packs start, number of starts and offset. What matters of equal texts is whether there are
    two, so a task emits at most two of them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            for value in batch.column(0):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                tid = text_id(data)
                met[tid] = met.get(tid, 0) + 1
                if met[tid] > 2:
                    continue
                anchor, first, number, offset = segments(data, length)
                ends = (first + number - 1 + length).tolist()
                seg = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends)], np.uint64)
                parts.append((anchor, seg, np.full(len(seg), tid, np.int64), first << 16 | number << 8 | offset))
                size += len(seg)
                if size > 200_000:
                    yield _packed(parts)
                    parts, size = [], 0
            if parts:
                yield _packed(parts)

    return small_batches(docs.select(text)).mapInArrow(find, OCCURRENCES)


def _packed(parts: list[tuple]) -> pa.RecordBatch:
    columns = [_signed(np.concatenate(c)) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "tid", "place"])


# --- shards and their merge -------------------------------------------------------------------------


class Shard:
    """Transform of some segments: the order of their suffixes at the anchor, and the bytes before and behind.

    ``words`` holds what follows the anchor as big-endian numbers of eight bytes, so comparing numbers
    compares bytes; ``before`` holds the bytes that precede it, nearest first: the columns that a
    Burrows-Wheeler transform would show for the suffixes at the anchor, one byte further left, and so on.
    """

    def __init__(self, group: np.ndarray, data: list[bytes], offset: np.ndarray, length: int):
        n, reach = len(data), length - ANCHOR
        words = np.zeros((n, (length + 7) // 8 * 8), np.uint8)
        self.before = np.zeros((n, reach), np.uint8)
        for row, (piece, at) in enumerate(zip(data, offset.tolist())):
            behind = np.frombuffer(piece, np.uint8, offset=at)[:length]
            words[row, : len(behind)] = behind
            self.before[row, :at] = np.frombuffer(piece, np.uint8, at)[::-1]
        self.words = words.view(">u8").astype(np.uint64)
        self.group = group
        self.order = np.lexsort((*self.words.T[::-1], group))


def merged_order(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Order of all shards' suffixes and the common prefix of neighbours, by refining their interleave.

    At first the interleave lists shard after shard, each in its own order. Round d sorts it, stably and
    only inside blocks not yet told apart, by the d-th number behind the anchor: rows that a round parts
    have a common prefix that ends in that number. Orders inside a shard are kept, never worked out anew.
    """
    group = np.concatenate([s.group for s in shards])
    words = np.concatenate([s.words for s in shards])
    starts = np.cumsum([0, *(len(s.group) for s in shards)])
    order = np.concatenate([s.order + at for s, at in zip(shards, starts)])
    order = order[np.argsort(group[order], kind="stable")]
    g = group[order]
    bound = np.full(len(order), -1, np.int64)  # common prefix with the row before; -1: not parted yet
    bound[0] = 0
    bound[1:][g[1:] != g[:-1]] = 0
    for d in range(words.shape[1]):
        block = np.cumsum(bound >= 0) - 1
        size = np.bincount(block)
        live = np.flatnonzero(size[block] > 1)
        if not len(live):
            break
        rows, blocks = order[live], block[live]
        symbol = words[rows, d]
        again = np.lexsort((symbol, blocks))
        order[live] = rows[again]
        symbol = symbol[again]
        parted = np.flatnonzero((blocks[1:] == blocks[:-1]) & (symbol[1:] != symbol[:-1])) + 1
        differ = (symbol[parted] ^ symbol[parted - 1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        bound[live[parted]] = 8 * d + differ.argmax(1)
    bound[bound < 0] = 8 * words.shape[1]
    return order, bound


def repeated_starts(shards: list[Shard], offset: np.ndarray, number: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """For every segment and start, whether the ``length`` bytes there occur twice or more in its group.

    ``times`` is how often each segment occurs as a whole: equal ones are one suffix of that weight.

    Suffixes r bytes left of the anchor have a common prefix of ``length`` if r bytes before and
    ``length - r`` behind the anchor agree. Moving left by one byte parts each class by the byte moved
    over, which keeps the order of the rest; the common prefixes of the merged order give the classes
    behind the anchor. What both leave together is a repeated interval.
    """
    order, bound = merged_order(shards)
    before = np.concatenate([s.before for s in shards])[order]
    off, num, weight = offset[order], number[order], np.minimum(times[order], 2)
    found = np.zeros((len(order), length - ANCHOR + 1), bool)
    left = np.zeros(len(order), np.int64)
    for r in range(length - ANCHOR + 1):
        if r:
            step = left * 257 + np.where(off >= r, before[:, r - 1].astype(np.int64), 256)
            _, left = np.unique(step, return_inverse=True)
        behind = np.cumsum(bound < length - r)
        live = np.flatnonzero((off >= r) & (off - r < num))
        if not len(live):
            continue
        key = behind[live] * (left.max() + 1) + left[live]
        _, inverse = np.unique(key, return_inverse=True)
        hit = live[np.bincount(inverse, weight[live])[inverse] > 1]
        found[hit, off[hit] - r] = True
    out = np.empty_like(found)
    out[order] = found
    return out


def _shard_merge(length: int, shard_rows: int):
    """(anchor, seg, start, end): runs of starts in each kind of segment whose strings are repeated."""

    def spans_of(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        anchor, seg, block = (t.column(c).to_numpy() for c in ("anchor", "seg", "block"))
        _, first = np.unique(np.stack((block, anchor, seg), 1), axis=0, return_index=True)
        t = t.take(pa.array(np.sort(first)))
        block, anchor, place = (t.column(c).to_numpy() for c in ("block", "anchor", "place"))
        _, group = np.unique(np.stack((block, anchor), 1), axis=0, return_inverse=True)
        data, offset, number = t.column("data").to_pylist(), place & 255, place >> 8 & 255
        shards = [
            Shard(group[at : at + shard_rows], data[at : at + shard_rows], offset[at : at + shard_rows], length)
            for at in range(0, len(data), shard_rows)
        ]
        found = repeated_starts(shards, offset, number, t.column("n").to_numpy(), length)
        edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        own = [pa.array(t.column(c).to_numpy()[row]) for c in ("anchor", "seg")]
        return pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["anchor", "seg", "start", "end"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in runs(batches):
            held.append(table)
            size += table.num_rows
            if size >= 16_384:
                yield spans_of(held)
                held, size = [], 0
        if held:
            yield spans_of(held)

    return merge


# --- whole operator ---------------------------------------------------------------------------------

FILTER_BITS = 22


def _id_filter(rows: DataFrame) -> np.ndarray:
    """Which prefixes text ids have: at most 2**FILTER_BITS numbers to the driver, however many texts."""
    got = rows.select(F.shiftrightunsigned("tid", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[got.column("b").to_numpy()] = True
    return bitmap


def _bucket(tid: int) -> int:
    return (tid & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)


def _texts(docs: DataFrame, text: str, bitmap) -> DataFrame:
    """(tid, data) of the texts whose id may be wanted; equal texts once in each task."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            ids, texts = [], []
            for value in batch.column(0):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                tid = text_id(data)
                if bitmap.value[_bucket(tid)] and tid not in met:
                    met.add(tid)
                    ids.append(tid)
                    texts.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["tid", "data"])

    return docs.select(text).mapInArrow(pick, "tid bigint, data binary")


REPEATED = "anchor bigint, seg bigint, start bigint, end bigint"
CUT = "anchor bigint, seg bigint, tid bigint, place bigint, n bigint, size bigint, data binary"


def _cut(length: int):
    """The bytes of the wanted segments of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tid, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("tid", "data", "wanted"))):
                for w in wanted:
                    at = w["place"] >> 16
                    out.append((w["anchor"], w["seg"], tid, w["place"], w["n"], w["size"], data[at : at + (w["place"] >> 8 & 255) - 1 + length]))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())],
                names=["anchor", "seg", "tid", "place", "n", "size", "data"],
            )

    return cut


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 200, block_rows: int = 8_192) -> DataFrame:
    """(tid, lo, hi): byte spans of texts that are covered by strings of ``length`` bytes starting elsewhere too."""
    spark = docs.sparkSession
    # Stored, so that the join below has plain exchanges on both sides and a frequent anchor can be split.
    counts = stored(occurrences(docs, text, length).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    again = stored(occurrences(docs, text, length).join(counts, "anchor"))
    classes = stored(again.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("tid", "place")).alias("rep")))
    # Segments of equal bytes are folded into one that weighs as many; one of each kind meets the others of
    # its anchor, and what is found for it holds for all of its kind.
    kinds = stored(classes.groupBy("anchor").agg(F.count("*").alias("size")))
    wanted = classes.join(kinds, "anchor").groupBy("rep.tid").agg(
        F.collect_list(F.struct("anchor", "seg", "rep.place", "n", "size")).alias("wanted")
    )
    wanted = stored(wanted)
    bitmap = spark.sparkContext.broadcast(_id_filter(wanted))
    pieces = _texts(docs, text, bitmap).join(wanted, "tid").select("tid", "data", "wanted").mapInArrow(_cut(length), CUT)
    _, blocks = block_keys(F.col("seg"), F.col("size"), block_rows)
    dealt = pieces.select("*", F.explode(blocks).alias("b")).select(
        F.xxhash64("anchor", "b.i", "b.j").alias("block"), "anchor", "seg", "tid", "place", "n", "data"
    )
    runs_of_kinds = stored(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_shard_merge(length, 4_096), REPEATED))
    first = F.shiftright("place", 16)
    return again.join(runs_of_kinds, ["anchor", "seg"]).select(
        "tid", (first + F.col("start")).alias("lo"), (first + F.col("end") - 1 + length).alias("hi")
    )


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, with_spans: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts anywhere else,
    in the same text or another. Strings are judged on the input and never cross texts. ``n_spans`` counts
    maximal removed runs; ``with_spans`` adds them as ``spans array<struct<lo, hi>>``.

    Every string of ``length`` bytes names an anchor in it by content, so equal strings name equal anchors.
    Anchors found once are out. Of the segments around the others one of each kind is cut out, with the
    number of its copies, and dealt by anchor into blocks of bounded size, where shard transforms are merged;
    the repeated intervals of the merged order decide, and every copy gets what was found for its kind.
    Null and shorter texts lose nothing. Equal rows are each other's copies. Texts are told apart by a
    64-bit hash in joins; extra columns and the id play no part, so ids may repeat or be null.
    """
    spark = docs.sparkSession
    spans = stored(repeated_spans(docs, text, length).groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    bitmap = spark.sparkContext.broadcast(_id_filter(spans))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts, shas = [], [], [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                tid = text_id(data)
                maybe = bool(bitmap.value[_bucket(tid)])
                ids.append(tid)
                sizes.append(len(data))
                texts.append(data if maybe else None)
                shas.append(None if maybe else hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()), pa.array(shas, pa.string())],
                names=["doc_id", "tid", "n_bytes", "data", "sha"],
            )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, runs_, shas, kept_spans = [], [], [], []
            for data, sha, marks in zip(batch.column("data"), batch.column("sha").to_pylist(), batch.column("spans")):
                spans_ = _merged(marks.as_py() or []) if data.is_valid else []
                if sha is None:
                    raw, at, digest = data.as_py(), 0, hashlib.sha256()
                    for lo, hi in spans_:
                        digest.update(raw[at:lo])
                        at = hi
                    digest.update(raw[at:])
                    sha = digest.hexdigest()
                gone.append(sum(hi - lo for lo, hi in spans_))
                runs_.append(len(spans_))
                shas.append(sha)
                kept_spans.append([{"lo": lo, "hi": hi} for lo, hi in spans_])
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(gone, pa.int64()), pa.array(runs_, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_spans:
                columns.append(pa.array(kept_spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", text).mapInArrow(split, "doc_id bigint, tid bigint, n_bytes bigint, data binary, sha string")
    schema = RESULT + (", spans array<struct<lo: bigint, hi: bigint>>" if with_spans else "")
    return rows.join(spans, "tid", "left").select("doc_id", "n_bytes", "data", "sha", "spans").mapInArrow(remove, schema)
