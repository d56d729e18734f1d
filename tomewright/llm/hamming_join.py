"""MinHash near-duplicates by a multi-index Hamming join: no pair under the signature distance is missed.

A text's set of word n-grams becomes a signature of ``chunks * width`` bytes, each the low byte of a
smallest hash. Two signatures that differ in at most ``chunks * (errors + 1) - 1`` places have a chunk with
at most ``errors`` differing places (pigeonhole), so they share that chunk with some ``errors`` places left
out. Every chunk is therefore indexed under each choice of places left out, and all pairs below the distance
meet under a key. Those that are that near form clusters; in a cluster the full sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm import common
from tomewright.llm.common import is_empty, small_batches, stored
from tomewright.llm.components import connected_components
from tomewright.llm.ngram_join import minhashes

SIGNED = "doc_id bigint, set_key binary, n_shingles bigint, signature binary"

#: Signatures compared in one task, and weight of the sets in one (a weight of 1 stands for up to 2,048 n-grams).
SIGNATURE_BLOCK = 4_096
SET_BLOCK = 256


class WordSets:
    """Sets of 64-bit hashes of word n-grams: A-Z lower-cased, words between blanks and control characters 9 to 13."""

    def __init__(self, n: int, keep: int = 300_000):
        self.n, self.keep = n, keep
        self.codes: dict[bytes, int] = {}
        self.factors = np.array([xxhash.xxh3_64_intdigest(b"place %d" % k) | 1 for k in range(n)], np.uint64)

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than n words is one n-gram, one without words has none."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.codes) > self.keep:
            self.codes.clear()
        codes = self.codes
        for w in set(words):
            if w not in codes:
                codes[w] = xxhash.xxh3_64_intdigest(w)
        c = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        m = max(1, len(c) - self.n + 1)
        total = np.full(m, min(len(c), self.n), np.uint64)
        for k in range(min(self.n, len(c))):
            total += c[k : k + m] * self.factors[k]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int, places: int, text: str) -> DataFrame:
    """(doc_id, set_key, n_shingles, signature) of every row; without n-grams key and signature are null."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = WordSets(n)
        factors = np.array([xxhash.xxh3_64_intdigest(b"order %d" % k) | 1 for k in range(places)], np.uint64)
        for batch in batches:
            keys, sizes, signed = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                found = sets.of(value.as_py())
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                low = minhashes(found, factors) * np.uint32(2654435761) >> np.uint32(24)
                signed.append(low.astype(np.uint8).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary())],
                names=["doc_id", "set_key", "n_shingles", "signature"],
            )

    return small_batches(docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string"))).mapInArrow(make, SIGNED)


def chunk_keys(signature, chunks: int, width: int, errors: int):
    """All keys of a signature: each chunk with every choice of ``errors`` places left out, as an array column."""
    keys, number = [], 0
    for chunk in range(chunks):
        for out in combinations(range(width), errors):
            kept = [F.substring(signature, chunk * width + k + 1, 1) for k in range(width) if k not in out]
            keys.append(F.xxhash64(F.concat(*kept), F.lit(number)))
            number += 1
    return F.array(*keys)


class NearSignatures:
    """Signatures of a block: near are those within the radius whose set sizes allow the similarity."""

    def __init__(self, table: pa.Table, radius: int, over: int, under: int):
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        self.size = table.column("n_shingles").to_numpy()
        self.radius, self.over, self.under = radius, over, under
        self.valid = np.ones(table.num_rows, bool)

    def near(self, a: int | np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each of ``others`` is near row ``a``, or near the row of ``a`` that stands at its place."""
        size, mine = self.size[others], self.size[a]
        out = np.minimum(size, mine) * self.under >= np.maximum(size, mine) * self.over
        at = np.flatnonzero(out)
        for k in range(0, len(at), 65_536):
            part = at[k : k + 65_536]
            pair = self.signature[others[part]] != self.signature[a[part] if isinstance(a, np.ndarray) else a]
            out[part] = pair.sum(1, dtype=np.int16) <= self.radius
        return out


class NearSets:
    """Full sets of a block, made from its texts; rows whose text has another set than their key says are void."""

    def __init__(self, table: pa.Table, n: int, over: int, under: int):
        words = WordSets(n)
        self.sets = [words.of(t.as_py()) for t in table.column("text").cast(pa.binary())]
        self.valid = np.array([set_key(s) == k for s, k in zip(self.sets, table.column("set_key").to_pylist())], bool)
        self.size = np.array([len(s) for s in self.sets])
        self.over, self.under = over, under

    def near(self, a: int, others: np.ndarray) -> np.ndarray:
        mine, size = self.sets[a], self.size[others]
        at = np.cumsum(np.append(0, size))
        every = np.concatenate([self.sets[k] for k in others])
        place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        common = np.add.reduceat((mine[place] == every).astype(np.int64), at[:-1])
        return common * self.under >= (len(mine) + size - common) * self.over


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Record batches sorted by their first column, regrouped into tables that cut no block."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        block = table.column(0)
        last = block[-1].as_py()
        start = int(np.searchsorted(block.to_numpy(), last)) if block[0].as_py() != last else 0
        if start:
            yield table.slice(0, start).combine_chunks()
        held = table.slice(start)
    if held is not None:
        yield held.combine_chunks()


def _links(judge: Callable[[pa.Table], NearSignatures | NearSets]):
    """Stars (a, b) that join what is near in each block, not one row for each near pair.

    A block of one side is searched breadth first, so that members joined already are not compared again;
    the first row of each block is compared with the others of all blocks at once where ``judge`` can do that.
    In a block of two sides a row of side 1 is compared with those of side 0 that belong elsewhere so far.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            judged = judge(table)
            block, side, node = (table.column(c).to_numpy() for c in ("block", "side", "node"))
            rows = np.flatnonzero(judged.valid)
            rows = rows[np.lexsort((node[rows], side[rows], block[rows]))]
            same = (block[rows[1:]] == block[rows[:-1]]) & (side[rows[1:]] == side[rows[:-1]])
            rows = rows[np.append(True, ~(same & (node[rows[1:]] == node[rows[:-1]])))] if len(rows) else rows
            if not len(rows):
                continue
            first = np.append(True, block[rows[1:]] != block[rows[:-1]])
            cuts = np.flatnonzero(first)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            if side.any():
                belongs = table.column("component").to_numpy().copy()
                for part in np.split(rows, cuts[1:]):
                    all_, some = part[side[part] == 0], part[side[part] == 1]
                    for a in some:
                        others = all_[belongs[all_] != belongs[a]]
                        if len(others):
                            hit = others[judged.near(a, others)]
                            ends.append((hit, np.full(len(hit), a)))
                            belongs[part[np.isin(belongs[part], belongs[hit])]] = belongs[a]
            else:
                star = np.zeros(len(rows), bool)
                if isinstance(judged, NearSignatures):
                    of = rows[cuts[np.cumsum(first) - 1]]
                    star[~first] = judged.near(of[~first], rows[~first])
                    ends.append((rows[star], of[star]))
                near, out = (np.add.reduceat(x.astype(np.int64), cuts) for x in (star, ~star & ~first))
                open_ = np.flatnonzero((out > 1) | (out > 0) & (near > 0) | (out > 0) & (not isinstance(judged, NearSignatures)))
                edges = np.append(cuts, len(rows))
                for k in open_:
                    part, met = rows[edges[k] : edges[k + 1]], star[edges[k] : edges[k + 1]]
                    left, start = part[1:][~met[1:]], part[0]
                    queue = part[1:][met[1:]].tolist() if isinstance(judged, NearSignatures) else [start]
                    while True:
                        while queue and len(left):
                            hit = judged.near(queue.pop(), left)
                            ends.append((left[hit], np.full(int(hit.sum()), start)))
                            queue += left[hit].tolist()
                            left = left[~hit]
                        if len(left) < 2:
                            break
                        start, left = left[0], left[1:]
                        queue = [start]
            a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return link


def _linked(blocks: DataFrame, judge) -> DataFrame:
    ordered = blocks.repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(_links(judge), "a bigint, b bigint").distinct()


def near_links(groups: DataFrame, attach: Callable[[DataFrame], DataFrame], judge, block: int) -> DataFrame:
    """Edges (a, b) whose components are those of the near pairs within each group of ``groups(grp, weight, node)``.

    ``attach`` adds to rows with a node what ``judge`` compares. A group of up to ``block`` in weight is one block.
    A larger one is dealt into blocks of that size twice, by different hashes, which joins groups of copies
    as a rule. Where a large group still is in several components, every member outside its largest one
    is compared with all members of other components, block by block, so no near pair is lost and
    a group of copies costs in proportion to its size.
    """
    n = F.ceil(F.col("weight") / block).cast("int")
    deal = lambda k: F.struct(F.lit(k).alias("deal"), F.pmod(F.xxhash64("node", F.lit(k)), n).alias("part"))
    deals = F.when(n > 1, F.array(deal(1), deal(2))).otherwise(F.array(F.struct(F.lit(0).alias("deal"), F.lit(0).cast("bigint").alias("part"))))
    dealt = groups.select("node", "grp", F.explode(deals).alias("d")).select("node", F.xxhash64("grp", "d.deal", "d.part").alias("block"))
    plain = dealt.select("block", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("component"), "node")
    edges = stored(_linked(attach(plain), judge))
    large = groups.where(F.col("weight") > block)
    if is_empty(large):
        return edges
    joined = connected_components(edges)
    large = stored(
        large.join(joined, "node", "left").select("grp", "weight", "node", F.coalesce("component", "node").alias("component"))
    )
    counts = large.groupBy("grp", "component").agg(F.count("*").alias("size"))
    several = counts.groupBy("grp").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("components"),
        (F.sum("size") - F.max("size")).alias("outside"), F.sum("size").alias("size"),
    ).where("components > 1")
    share = F.col("weight") / F.col("size")
    open_ = stored(
        large.join(several, "grp")
        .withColumn("parts", F.ceil(F.col("outside") * share / block).cast("int"))
        .withColumn("all_parts", F.ceil(F.col("weight") / block).cast("int"))
    )
    if is_empty(open_):
        return edges
    part = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    range_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    whole = open_.select("node", "component", "grp", F.lit(0).alias("side"), range_("parts").alias("p"), part(3, "all_parts").alias("q"))
    outer = open_.where("component <> main").select("node", "component", "grp", F.lit(1).alias("side"), part(4, "parts").alias("p"), range_("all_parts").alias("q"))
    crossed = whole.unionByName(outer).select(F.xxhash64("grp", "p", "q").alias("block"), "side", "component", "node")
    return edges.unionByName(stored(_linked(attach(crossed), judge)))


def _with_texts(docs: DataFrame, members: DataFrame, text: str) -> Callable[[DataFrame], DataFrame]:
    """Adds (set_key, text) to rows with a node: the text of the smallest id of the ``members(node, rep, set_key)``.

    Texts travel by id, in one join. While the members are few (``common.sent_ids``) their ids are sent to the scan of
    ``docs`` first, so that other texts stay where they are; beyond, all texts are shuffled once. An id with several
    rows gives each of its texts once; the judge knows by the key which one is meant.
    """
    ids = stored(members.select("rep").distinct())
    few = ids.count() <= common.BROADCAST_IDS
    every = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col(text).cast("string").alias("text")).where("rep IS NOT NULL")
    if few:
        every = every.join(F.broadcast(ids), "rep", "left_semi")
    counts = docs.groupBy(F.col("doc_id").cast("bigint").alias("rep")).agg(F.count("*").alias("rows")).where("rows > 1")
    repeated = stored(counts.join(ids, "rep").select("rep"))
    if not is_empty(repeated):
        several = every.join(repeated, "rep").groupBy("rep", F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.first("text").alias("text"))
        every = every.join(repeated, "rep", "left_anti").unionByName(several.select("rep", "text"))

    def attach(rows: DataFrame) -> DataFrame:
        named = stored(rows.join(members, "node"))
        return named.join(every, "rep").select(*rows.columns, "set_key", "text")

    return attach


def near_duplicates(
    docs: DataFrame, n: int = 2, threshold: tuple[int, int] = (80, 100), chunks: int = 16, width: int = 5, errors: int = 1,
    signature_block: int = SIGNATURE_BLOCK, set_block: int = SET_BLOCK, text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Texts whose sets of word ``n``-grams have a Jaccard similarity of at least ``threshold`` (a fraction)
    are linked; ``component_id`` is the smallest id reachable over links and equal sets, ``kept`` holds for
    that document. With the defaults every pair whose signatures differ in up to 31 of 80 places is
    compared in full; a pair of similarity just 0.8 differs in 16 on average and in more than 31 once
    in 33,000 times, one of 0.85 once in 19 million.

    Equal sets are folded first. Hot index keys and clusters are split (see ``near_links``). A text of fewer
    than ``n`` words is one n-gram of all its words; null texts and texts without words have an empty set
    and stay alone. Rows with a null id are linked with nothing and have null in the last two columns.
    Rows sharing an id and their set are one document; rows with one id and different texts are judged each
    by its own set. Extra columns are ignored.
    """
    over, under = threshold
    radius = chunks * (errors + 1) - 1
    signed = stored(signatures(docs, n, chunks * width, text))
    sets = stored(
        signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
        .groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = sets.select("node", F.explode(chunk_keys(F.col("signature"), chunks, width, errors)).alias("grp"))
    shared = keyed.groupBy("grp").agg(F.count("*").alias("weight")).where("weight > 1")
    met = stored(keyed.join(shared, "grp"))
    signature = sets.select("node", "n_shingles", "signature")
    close = near_links(
        met, lambda rows: rows.join(signature, "node").select(*rows.columns, "n_shingles", "signature"),
        lambda t: NearSignatures(t, radius, over, under), signature_block,
    )
    cluster = stored(connected_components(close))
    members = stored(cluster.join(sets.select("node", "rep", "set_key", "n_shingles"), "node"))
    weight = F.sum(F.ceil(F.col("n_shingles") / 2048)).cast("bigint").alias("weight")
    weights = stored(members.groupBy("component").agg(weight))
    groups = stored(members.join(weights, "component").select(F.col("component").alias("grp"), "weight", "node"))
    attach = _with_texts(docs, members.select("node", "rep", "set_key"), text)
    links = near_links(groups, attach, lambda t: NearSets(t, n, over, under), set_block)
    joined = connected_components(links)
    by_node = stored(sets.select("set_key", "node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    low = stored(by_node.groupBy("component").agg(F.min("rep").alias("component_id")))
    by_set = by_node.join(low, "component").select("set_key", "component_id")
    alone = "doc_id IS NULL OR set_key IS NULL"
    rows = signed.where(f"NOT ({alone})").join(by_set, "set_key").select("doc_id", "n_shingles", "component_id")
    rest = signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates_sql() -> str:
    """The same in DuckDB for two words and 0.8: pairs by shared n-grams, components by a recursive query."""
    return """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
             ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS grams FROM w),
sets AS (SELECT grams, min(doc_id) AS rep, len(grams) AS size FROM g WHERE len(grams) > 0 GROUP BY grams),
post AS (SELECT rep, size, unnest(grams) AS gram FROM sets),
met AS (SELECT a.rep AS a, b.rep AS b, a.size AS sa, b.size AS sb, count(*) AS common
        FROM post a JOIN post b ON a.gram = b.gram AND a.rep <> b.rep AND 100 * b.size >= 80 * a.size AND 100 * a.size >= 80 * b.size GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * common >= 80 * (sa + sb - common)),
reach(node, root) AS (SELECT a, a FROM links UNION SELECT b, root FROM reach JOIN links ON a = node),
low AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
ids AS (SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, coalesce(l.root, s.rep, g.doc_id) AS component_id
        FROM g LEFT JOIN sets s ON s.grams = g.grams LEFT JOIN low l ON l.node = s.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ids
"""
