"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright.llm.common import runs, stored

BITS, PARTS = 64, 8
PART_BITS = BITS // PARTS
#: Sub-codes to flip, by how many bits they flip.
FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(PART_BITS), n)], np.int64) for n in range(PART_BITS + 1)]

FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Hasher:
    """Codes of vectors: lifted to unit length, projected, rotated, cut at zero; and the radius to search."""

    bound: float  # largest length of all vectors
    mean: np.ndarray
    projection: np.ndarray
    radius: int

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with one more component, so that the nearest by angle is the largest inner product."""
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.bound)
        rest = np.zeros((len(x), 1)) if query else np.sqrt(np.clip(1 - (x * x).sum(1, keepdims=True), 0, None))
        return np.hstack([x, rest])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        bits = (self.lifted(x, query) - self.mean) @ self.projection > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _spread(axes: int, rng: np.random.Generator) -> np.ndarray:
    """Orthogonal columns, in as many rounds as it takes to give ``BITS`` of them from ``axes`` dimensions."""
    parts, have = [], 0
    while have < BITS:
        q, _ = np.linalg.qr(rng.standard_normal((axes, axes)))
        parts.append(q)
        have += axes
    return np.hstack(parts)[:, :BITS]


def fit(sample: np.ndarray, bound: float, k: int, recall: float, rounds: int = 40, probes: int = 256) -> Hasher:
    """Principal axes and a rotation that brings codes close to the vectors (alternating least squares).

    The radius is the one that holds the share ``recall`` of the true neighbours of some sample rows. A
    sample is sparser than the whole, so its neighbours are further away and the radius errs to the safe side.
    """
    h = Hasher(bound, np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, BITS)), BITS)
    x = h.lifted(sample, query=False)
    h.mean = x.mean(0)
    centred = x - h.mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(BITS, x.shape[1])]
    v = centred @ axes
    rotation = _spread(axes.shape[1], np.random.default_rng(7))
    if axes.shape[1] >= BITS:
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ rotation > 0, 1.0, -1.0))
            rotation = u @ w
    h.projection = axes @ rotation
    codes = h.codes(sample)
    asked = slice(0, min(probes, len(sample)))
    asked_codes = h.codes(sample[asked], query=True)
    score = sample[asked] @ sample.T
    np.fill_diagonal(score, -np.inf)
    k = min(k, len(sample) - 1)
    if k > 0:
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        far = np.bitwise_count(codes[near] ^ asked_codes[:, None])
        h.radius = int(np.quantile(far, recall, method="higher"))
    return h


class MultiIndex:
    """One table for each part of the codes: rows in order of the part's value, with the start of each value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(len(codes), PARTS)
        self.rows = [np.argsort(parts[:, p], kind="stable") for p in range(PARTS)]
        self.starts = [np.searchsorted(parts[self.rows[p], p], np.arange((1 << PART_BITS) + 1)) for p in range(PARTS)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits.

        Such a code differs in at most ``radius // PARTS`` bits in one part at least, so those values are
        looked up in each table; the whole codes of what they hold are then compared.
        """
        hit = np.zeros(len(self.codes), bool)
        value = np.array([code], np.uint64).view(np.uint8).astype(np.int64)
        for p in range(PARTS):
            rows, starts = self.rows[p], self.starts[p]
            for flips in FLIPS[: min(radius // PARTS, PART_BITS) + 1]:
                for v in flips ^ value[p]:
                    hit[rows[starts[v] : starts[v + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _exact(query: np.ndarray, vector: np.ndarray) -> float:
    """Inner product, correctly rounded: equal vectors get equal scores."""
    return math.fsum((query * vector).tolist())


def _search(hasher, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher.value
        for table in runs(batches):
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            ids = table.column("vec_id").to_numpy()
            if not asks.any() or asks.all():
                continue
            x = np.array(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
            held, held_ids = x[~asks], ids[~asks]
            index = MultiIndex(h.codes(held))
            known = set(held_ids.tolist())
            different = len(known)
            out: tuple[list, list, list] = ([], [], [])
            for query_id, query, code in zip(ids[asks], x[asks], h.codes(x[asks], query=True)):
                others = different - (query_id in known)
                radius = h.radius
                while True:
                    rows = index.within(code, radius)
                    rows = rows[held_ids[rows] != query_id]
                    if len(rows) >= min(k, others) and len(np.unique(held_ids[rows])) >= min(k, others) or radius >= BITS:
                        break
                    radius += 2
                rough = held[rows] @ query
                # The floor is the k-th best of different ids, each by its best row.
                order = np.lexsort((-rough, held_ids[rows]))
                heads = order[np.concatenate(([True], np.diff(held_ids[rows][order]) != 0))] if len(order) else order
                if len(heads) > k:
                    floor = np.partition(rough[heads], len(heads) - k)[len(heads) - k]
                    close = rough >= floor - 1e-9 * (1 + abs(floor))
                    rows = rows[close]
                best = sorted((-_exact(query, held[r]), int(held_ids[r])) for r in rows)
                taken: set[int] = set()
                for score, vec_id in best:
                    if vec_id not in taken:
                        taken.add(vec_id)
                        for part, value in zip(out, (query_id, vec_id, -score)):
                            part.append(value)
                        if len(taken) == k:
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"]
            )

    return search


def usable(vector: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, sample: int = 8192,
    shard_rows: int = 16_384, slab_rows: int = 1_024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query found by code.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but the query's own. Codes
    are learnt on at most ``sample`` ids, taken in order of a hash of their id; every row is indexed. The
    rows are dealt by a hash of their id into shards and the queries into slabs, both of bounded size; each
    pair of them is one block with its own tables, whose best ``k`` are merged. Scores are exact. Ties go
    to the smaller id, many equal vectors included. A block with too few codes within the radius widens it.

    Rows without id or with an unusable vector take no part, nor do vectors whose length differs from the
    commonest one. Rows with one id count as one query, and once in each result, by
    the best of their vectors; equal rows are folded first, and the ``k`` are different ids. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("embedding") == width["width"]).withColumn("asked", F.coalesce(is_query, F.lit(False)))
    rows = stored(rows.groupBy("vec_id", "embedding").agg(F.max("asked").alias("asked")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, asked, bound = rows.agg(F.count("*"), F.count_if("asked"), F.max(length)).first()
    taken = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = np.array(taken.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, width["width"])
    hasher = spark.sparkContext.broadcast(fit(x, float(bound), k, recall))

    shards, slabs = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / slab_rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    slab = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(slabs)).cast("int")
    held = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), own.alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding"
    )
    queries = rows.where("asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = queries.select(
        slab.alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding"
    )
    blocks = held.unionByName(asking).select((F.col("slab").cast("bigint") * shards + F.col("shard")).alias("block"), "asks", "vec_id", "embedding")
    found = blocks.repartition(shards * slabs, "block").sortWithinPartitions("block").mapInArrow(_search(hasher, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
