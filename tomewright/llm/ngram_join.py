"""N-gram Jaccard join: a MinHash LSH forest proposes, exact comparison of shingle sets decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import block_keys, is_empty, runs, sent_ids, small_batches, stored
from tomewright.llm.components import connected_components

#: Pairs whose sketches agree in fewer than this share of positions are not compared by text. With 80
#: positions a pair of similarity 0.8 stays above by more than six standard deviations.
SKETCH_FLOOR = 0.5

SIGNATURES = "doc_id bigint, key string, prefixes array<bigint>, sketch binary"


def forest_depth(trees: int, levels: int, threshold: float, recall: float) -> int:
    """The matched prefix, shortened from ``levels`` until a pair at ``threshold`` is met with ``recall``."""
    depth = levels
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingler:
    """Sets of hashed word n-grams of whole texts; lower case, words cut at white space."""

    def __init__(self, n: int, keep: int = 300_000):
        self.n, self.keep = n, keep
        self.codes: dict[str, int] = {}
        self.factors = np.array([xxhash.xxh3_64_intdigest(b"word %d" % k) | 1 for k in range(n)], np.uint64)

    def code(self, word: str) -> int:
        value = self.codes[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than n words is one shingle, an empty one has none."""
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.codes) > self.keep:
            self.codes.clear()
        get, code = self.codes.get, self.code
        c = np.fromiter((get(w) or code(w) for w in words), np.uint64, len(words))
        m = max(1, len(c) - self.n + 1)
        total = np.zeros(m, np.uint64)
        for k in range(min(self.n, len(c))):
            total += c[k : k + m] * self.factors[k]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)


def _key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def _hash_factors(count: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"permutation %d" % k) | 1 for k in range(count)], np.uint64)


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each of many permutations, upper 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (factors[:, None] * shingles[None, at : at + 1024]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, n: int, trees: int, levels: int, depth: int, text: str = "text") -> DataFrame:
    """(doc_id, key, prefixes, sketch) of every text with a shingle.

    ``key`` is a digest of the whole shingle set, ``sketch`` holds ``levels`` minima for each tree, and
    ``prefixes`` the digest of the first ``depth`` of them: the trie node where a tree's search ends.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(n), _hash_factors(trees * levels)
        for batch in batches:
            ids, keys, prefixes, sketches = [], [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingler.shingles(value.as_py())
                if not len(found):
                    continue
                low = minhashes(found, factors).reshape(trees, levels)
                ids.append(doc_id)
                keys.append(_key(found))
                prefixes.append([xxhash.xxh3_64_intdigest(row[:depth].tobytes(), t) - (1 << 63) for t, row in enumerate(low)])
                sketches.append(low.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "key", "prefixes", "sketch"],
            )

    return small_batches(docs.select("doc_id", text)).mapInArrow(make, SIGNATURES)


def keyed_texts(docs: DataFrame, n: int) -> DataFrame:
    """(rep, key, text): the texts of ``docs(rep, text)`` beside the digest of their shingle set, one row of each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            keys = [_key(shingler.shingles(value.as_py())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), batch.column(1)], names=["rep", "key", "text"])

    made = small_batches(docs.select(F.col("rep").cast("bigint"), "text")).mapInArrow(make, "rep bigint, key string, text string")
    return made.groupBy("rep", "key").agg(F.first("text").alias("text"))


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric link matrix."""
    n = len(linked)
    roots = np.arange(n)
    while True:
        low = np.minimum(roots, np.where(linked, roots[None, :], n).min(1))
        low = np.minimum(low, low[low])
        if (low == roots).all():
            return roots
        roots = low


def _to_compare(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Distinct members of a block and the matrix of pairs that are this block's to compare."""
    keys = table.column("key").to_numpy(zero_copy_only=False)
    _, first = np.unique(keys, return_index=True)
    table = table.take(pa.array(first))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    chunk = table.column("chunk").to_numpy()
    pairs = np.ones((len(chunk), len(chunk)), bool) if i == j else chunk[:, None] != chunk[None, :]
    np.fill_diagonal(pairs, False)
    return table, pairs


def _trie_links(trees: int, levels: int, depth: int):
    """Links of each trie node's members whose sketches agree, as stars (a, b); prefixes shorten level by level."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            table, pairs = _to_compare(table)
            if table.num_rows < 2:
                continue
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(table.num_rows, -1)
            tree = table.column("tree")[0].as_py()
            path = sketch[:, tree * levels : (tree + 1) * levels]
            order = np.lexsort(path.T[::-1])  # the tree's sorted trie
            path, sketch, pairs = path[order], sketch[order], pairs[np.ix_(order, order)]
            linked = np.zeros_like(pairs)
            roots = np.arange(len(order))
            need = int(np.ceil(SKETCH_FLOOR * sketch.shape[1]))
            for level in range(levels, depth - 1, -1):
                node = np.concatenate(([0], np.cumsum((path[1:, :level] != path[:-1, :level]).any(1))))
                for start, end in zip(np.searchsorted(node, np.arange(node[-1] + 1)), np.searchsorted(node, np.arange(node[-1] + 1), "right")):
                    if end - start < 2 or (roots[start:end] == roots[start]).all():
                        continue  # joined further down already
                    for a in range(start, end):
                        agree = (sketch[start:end] == sketch[a]).sum(1) >= need
                        linked[a, start:end] |= agree & pairs[a, start:end]
                linked |= linked.T
                roots = _local_roots(linked)
            keys = table.column("key").to_numpy(zero_copy_only=False)[order]
            far = np.flatnonzero(roots != np.arange(len(roots)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(keys[far], pa.string()), pa.array(keys[roots[far]], pa.string())], names=["a", "b"])

    return link


def _exact_links(n: int, threshold: tuple[int, int]):
    """Number of links and local root of each member of a block, by exact Jaccard similarity of shingle sets."""
    over, under = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for table in runs(batches):
            table, pairs = _to_compare(table)
            if table.num_rows < 2:
                continue
            sets = [shingler.shingles(t.as_py()) for t in table.column("text")]
            keys = table.column("key").to_pylist()
            size = np.array([len(s) for s in sets])
            every, place = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            linked = np.zeros_like(pairs)
            flag = np.zeros(len(every), np.int32)
            for a in np.flatnonzero(pairs.any(1)):
                mine = place[starts[a] : starts[a] + size[a]]
                flag[mine] = 1
                common = np.add.reduceat(flag[place], starts)
                flag[mine] = 0
                linked[a] = pairs[a] & (common * under >= (size[a] + size - common) * over)
            hits = linked.sum(1)
            kept = np.flatnonzero(hits)
            if len(kept):
                roots = _local_roots(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in kept], pa.string()), pa.array([keys[k] for k in roots[kept]], pa.string()), pa.array(hits[kept], pa.int64())],
                    names=["key", "root", "n_links"],
                )

    return compare


def jaccard_classes(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 16, levels: int = 5,
    recall: float = 0.999, block_rows: int = 192, text: str = "text",
) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row of ``docs``.

    Texts whose sets of word ``n``-grams have a Jaccard similarity of at least ``threshold`` (a fraction)
    are linked; ``n_links`` counts the different sets a document's set is linked with, ``n_copies`` the
    rows with the very same set, itself included. ``class_id`` is the smallest id of the documents joined
    by equal sets and links.

    Equal sets are folded first, so copies are never paired. Each set has a path in every tree of a
    forest; sets that meet in a node at the depth that gives ``recall`` at the threshold, and whose
    sketches agree, form clusters; inside a cluster all sets are compared exactly. Trie nodes and clusters
    of any size are cut into blocks of bounded size, and a block returns one row per member, never pairs.

    A text of fewer than ``n`` words is one n-gram; null, empty and blank texts have none and stay alone,
    as do rows with a null id. Rows with the same id and different texts belong to the class of the
    smallest; extra columns are ignored.
    """
    depth = forest_depth(trees, levels, threshold[0] / threshold[1], recall)
    signed = stored(signatures(docs.where(F.col("doc_id").isNotNull()), n, trees, levels, depth, text))
    sets = stored(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("prefixes").alias("prefixes"), F.first("sketch").alias("sketch")
        )
    )
    nodes = sets.select("key", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1")
    chunk, blocks = block_keys(F.col("key"), F.col("size"), 2 * block_rows)
    met = (
        nodes.join(shared, ["tree", "prefix"])
        .select("key", "tree", "prefix", chunk.alias("chunk"), F.explode(blocks).alias("b"))
        .select("key", "tree", "chunk", "b.i", "b.j", F.xxhash64("tree", "prefix", "b.i", "b.j").alias("block"))
    )
    sketched = met.join(sets.select("key", "sketch"), "key").select("block", "tree", "i", "j", "chunk", "key", "sketch")
    near = sketched.repartition("block").sortWithinPartitions("block").mapInArrow(_trie_links(trees, levels, depth), "a string, b string")
    clusters = stored(connected_components(near))

    sizes = stored(clusters.groupBy("component").agg(F.count("*").alias("size")))
    chunk, blocks = block_keys(F.col("key"), F.col("size"), block_rows)
    members = stored(
        clusters.join(sizes, "component").select(F.col("node").alias("key"), "component", "size")
        .join(sets.select("key", "rep"), "key")
    )
    # A set's text is that of its smallest id. Where other rows have that id too, it is found by its key.
    every = docs.select(F.col("doc_id").alias("rep"), F.col(text).alias("text"))
    every = every.join(sent_ids(members.select("rep").distinct()), "rep", "left_semi")
    shared_ids = stored(
        docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("rows")).where("rows > 1")
        .join(members, "rep", "left_semi").select("rep")
    )
    found = every.join(members, "rep")
    if not is_empty(shared_ids):
        several = keyed_texts(every.join(shared_ids, "rep", "left_semi"), n).join(members, ["rep", "key"])
        single = every.join(members.join(shared_ids, "rep", "left_anti"), "rep")
        found = single.unionByName(several)
    texts = (
        found.select("key", "component", "text", chunk.alias("chunk"), F.explode(blocks).alias("b"))
        .select(F.xxhash64("component", "b.i", "b.j").alias("block"), "b.i", "b.j", "chunk", "key", "text")
    )
    links = stored(
        texts.repartition("block").sortWithinPartitions("block")
        .mapInArrow(_exact_links(n, threshold), "key string, root string, n_links bigint")
    )
    joined = connected_components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    linked = stored(
        sets.select("key", "rep", "n_copies")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .join(counts, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    smallest = stored(linked.groupBy("component").agg(F.min("rep").alias("class_id")))
    by_set = linked.join(smallest, "component").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    rows = signed.select("doc_id", "key").join(by_set, "key").select("doc_id", "class_id", "n_links", "n_copies")
    rest = docs.where(F.col("doc_id").isNull() | (F.coalesce(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit("")) == ""))
    return rows.unionByName(
        rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    )


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its class; columns unchanged.

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    classes = jaccard_classes(docs, **how)
    drop = sent_ids(classes.where("doc_id <> class_id").select("doc_id").distinct())
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def jaccard_sql(n: int = 5) -> str:
    """The same in DuckDB for the threshold 0.8: pairs by shared n-grams, classes by a recursive query."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) END AS grams
      FROM w WHERE len(w) > 0),
sets AS (SELECT grams, min(doc_id) AS rep, count(*) AS n_copies, len(grams) AS size FROM g GROUP BY grams),
post AS (SELECT rep, size, unnest(grams) AS gram FROM sets),
met AS (SELECT a.rep AS a, b.rep AS b, a.size AS sa, b.size AS sb, count(*) AS common
        FROM post a JOIN post b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 5 * common >= 4 * (sa + sb - common)),
reach(node, root) AS (SELECT a, a FROM links UNION SELECT b, root FROM reach JOIN links ON a = node),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, s.rep, d.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(s.n_copies, 1)::BIGINT AS n_copies
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN sets s ON s.grams = g.grams
LEFT JOIN classes c ON c.node = s.rep LEFT JOIN counts k ON k.a = s.rep
"""
