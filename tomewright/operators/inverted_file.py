"""Search by cells: vectors are assigned to coarse cells and a query visits few of them.

``probe_topk`` visits the nearest cells and is approximate. ``pruned_topk`` is exact: a cell's centre and radius
bound every inner product in it, so cells whose bound lies below the k-th best found are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions.vectors import group_means
from tomewright.operators.topk import RESIDENT_BYTES, TILE_CELLS, _matrix, _unit, portion_rows, similarity_topk
from tomewright.session import durable


def train_cells(df: DataFrame, vec_col: str, n_cells: int, id_col: str = "vec_id", rounds: int = 4) -> DataFrame:
    """``(cell, centroid)`` by spherical k-means over all vectors.

    The vectors whose ids hash lowest are the first centres; each round assigns every vector to its nearest
    centre and takes the means, which are merged before the shuffle. The centres are stored after each round,
    so a round reads the vectors once. Cells that lose all vectors are gone.
    """
    first = Window.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col)
    lowest = df.select(id_col, vec_col).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n_cells)
    centres = lowest.select((F.row_number().over(first) - 1).cast("long").alias("cell"), F.col(vec_col).cast("array<double>").alias("centroid"))
    for _ in range(rounds):
        centres = durable(group_means(nearest_cells(df, vec_col, _unit_length(centres), 1, id_col=id_col), vec_col, "cell"))
    return _unit_length(centres)


def _unit_length(centres: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return centres.select("cell", F.transform("centroid", lambda x: F.when(length > 0, x / length).otherwise(x)).alias("centroid"))


def nearest_cells(
    df: DataFrame, vec_col: str, centroids: DataFrame, n: int, cell_col: str = "cell", id_col: str = "vec_id",
    room_bytes: int = RESIDENT_BYTES,
) -> DataFrame:
    """Explode every row of ``df`` to its ``n`` nearest cells by inner product (ties: smaller cell).

    Centroids go to every executor while they fit ``room_bytes``. More of them meet the rows, told apart by
    ``id_col``, in bounded tiles of the exact search.
    """
    table = centroids.select("cell", "centroid").orderBy("cell")
    head = table.select(F.size("centroid").alias("d")).head()
    room = room_bytes // (8 * head["d"])
    fetched = table.limit(room + 1).toArrow()
    if fetched.num_rows > room:
        asked = df.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("qvec"))
        cells = centroids.select("cell", F.col("centroid").cast("array<float>").alias("centroid"))
        found = similarity_topk(cells, asked, n, id_col="cell", vec_col="centroid", normalize=False, resident_bytes=0)
        return df.join(found.select(F.col("qid").alias(id_col), F.col("cell").alias(cell_col)), id_col).select(*df.columns, cell_col)
    shared = df.sparkSession.sparkContext.broadcast(
        (fetched["cell"].to_numpy(), _matrix(fetched["centroid"], np.float64))
    )
    schema = T.StructType([*df.schema.fields, T.StructField(cell_col, T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, mat = shared.value
        for b in batches:
            portion = max(1, min(TILE_CELLS // max(len(cells), n), portion_rows(mat.shape[1]) // min(len(cells), n)))
            for part in (b.slice(at, portion) for at in range(0, b.num_rows, portion)):
                scores = _matrix(part[vec_col], np.float64) @ mat.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                wide = part.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [*wide.columns, pa.array(cells[near.ravel()], pa.int64())], [*b.schema.names, cell_col]
                )

    return df.mapInArrow(assign, schema)


def cell_balls(members: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``(cell, centroid, radius, n_members)``: the largest distance of a member to the centre of its cell.

    Distances are folded per task before the shuffle; cells without members are left out.
    """
    away = F.zip_with(vec_col, "centroid", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    distance = F.sqrt(F.aggregate(away, F.lit(0.0), lambda s, x: s + x))
    sizes = (
        members.where(F.col(vec_col).isNotNull()).select("cell", vec_col).join(centroids, "cell")
        .groupBy("cell").agg(F.max(distance).alias("radius"), F.count(F.lit(1)).alias("n_members"))
    )
    return centroids.select("cell", "centroid").join(sizes, "cell")


def _within_reach(asked: pa.RecordBatch, cells: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells, other than those seen, whose bound is not below the bar of a query.

    Queries are taken in portions, and so is what they reach: a query leaves its vector once for each cell.
    """
    sizes = np.sqrt(np.einsum("ij,ij->i", centres, centres)) + radius
    portion, leaving = max(1, TILE_CELLS // max(1, len(cells))), portion_rows(centres.shape[1])
    for some in (asked.slice(at, portion) for at in range(0, asked.num_rows, portion)):
        qvec = _unit(_matrix(some["qvec"], np.float64))
        length = np.sqrt(np.einsum("ij,ij->i", qvec, qvec))[:, None]
        bound = qvec @ centres.T + length * radius
        bound += 1e-6 * length * sizes  # float32 sums of the search
        open_ = bound >= some["bar"].to_numpy(zero_copy_only=False)[:, None]
        for row, seen in enumerate(some["seen"].to_pylist()):
            open_[row, np.isin(cells, seen or [])] = False
        near = np.flatnonzero(open_)
        for at in range(0, len(near), leaving):
            row, cell = np.divmod(near[at : at + leaving], len(cells))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([some["qid"].take(rows), some["qvec"].take(rows), pa.array(cells[cell], pa.int64())], ["qid", "qvec", "probe"])


def cells_in_reach(queries: DataFrame, balls: DataFrame, room_bytes: int = RESIDENT_BYTES, tile_rows: int = 2048) -> DataFrame:
    """``(qid, qvec, probe)``: for ``queries(qid, qvec, bar, seen)`` every cell that can hold a vector at or above ``bar``.
    ``qvec`` keeps its type, as a query leaves with its vector once for each cell.

    An inner product of a unit query and a member is at most that with the centre plus the radius. Balls go to
    every executor while they fit ``room_bytes``; more of them meet the queries in tiles of bounded size.
    """
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qvec", F.col("bar").cast("double").alias("bar"), "seen")
    table = balls.select("cell", F.col("centroid").cast("array<double>").alias("centroid"), "radius")
    head = table.select(F.size("centroid").alias("d")).head()
    if head is None:
        return asked.select("qid", "qvec", F.lit(0).cast("long").alias("probe")).limit(0)
    room = room_bytes // (8 * head["d"])
    fetched = table.limit(room + 1).toArrow()
    if fetched.num_rows <= room:
        shared = queries.sparkSession.sparkContext.broadcast(
            (fetched["cell"].to_numpy(), _matrix(fetched["centroid"], np.float64), fetched["radius"].to_numpy())
        )

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _within_reach(b, *shared.value)

        return asked.mapInArrow(reach, asked.select("qid", "qvec", F.lit(0).cast("long").alias("probe")).schema)
    n_block, n_slab = max(1, -(-table.count() // tile_rows)), max(1, -(-asked.count() // tile_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("qid"), F.lit(n_slab)).cast("int").alias("slab"), every(n_block).alias("block"))
    right = table.select("*", F.pmod(F.xxhash64("cell"), F.lit(n_block)).cast("int").alias("block"), every(n_slab).alias("slab"))

    def tile(some: pa.Table, cells: pa.Table) -> pa.Table:
        if not some.num_rows or not cells.num_rows:
            return pairs.empty_table()
        held = cells["cell"].to_numpy(), _matrix(cells["centroid"], np.float64), cells["radius"].to_numpy()
        near = (reached.select(["qid", "probe"]) for b in some.to_batches() for reached in _within_reach(b, *held))
        return pa.Table.from_batches(near, pairs)

    pairs = pa.schema([("qid", pa.int64()), ("probe", pa.int64())])  # a tile returns no vectors: each would leave it once for every cell
    near = left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(tile, "qid bigint, probe bigint")
    return near.join(asked.select("qid", "qvec"), "qid").select("qid", "qvec", "probe")


def visited_cells(
    members: DataFrame, queries: DataFrame, balls: DataFrame, k: int, seeds: int = 2, **kw
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells ``(qid, qvec, probe)`` an exact search visits in its first and second round, and the hits of the first.

    The first round searches the ``seeds`` nearest cells of each query. Its k-th best is the bar for the second:
    all other cells whose bound reaches it are visited. A query that found fewer than k visits every cell.
    """
    first = durable(nearest_cells(queries.select("qid", "qvec"), "qvec", balls, seeds, "probe", id_col="qid"))
    hits = durable(_search_cells(members, first, k, **kw))
    bars = hits.where(F.col("rank") == k).select("qid", F.col("similarity").alias("bar"))
    seen = first.groupBy("qid").agg(F.first("qvec").alias("qvec"), F.collect_list("probe").alias("seen"))
    asked = seen.join(bars, "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    second = durable(cells_in_reach(asked, balls))
    return first, second, hits


def _search_cells(members: DataFrame, probes: DataFrame, k: int, **kw) -> DataFrame:
    """Top-k among the cells of ``probes(qid, qvec, probe)``; other cells of a stored index are not read.

    The distinct cells, at most one row per centroid, go to the scan as a join, so that Spark prunes the
    folders of a table partitioned by cell while the query runs. The test of ``probe`` lets it see
    that the join selects.
    """
    wanted = probes.where("probe >= 0").select(F.col("probe").alias("cell")).distinct()
    return similarity_topk(members.join(F.broadcast(wanted), "cell", "left_semi"), probes, k, cell=("cell", "probe"), **kw)


def pruned_topk(members: DataFrame, queries: DataFrame, balls: DataFrame, k: int, seeds: int = 2, id_col: str = "vec_id", **kw) -> DataFrame:
    """The same rows as ``similarity_topk``, without visiting cells that cannot hold one of the k best.

    ``members`` carries a ``cell``, ``balls`` comes from ``cell_balls`` over all of them. On vectors that lie in
    clusters most cells stay below the bar; on vectors without structure all of them are visited once.
    """
    _, second, hits = visited_cells(members, queries, balls, k, seeds, id_col=id_col, **kw)
    rest = _search_cells(members, second, k, id_col=id_col, **kw)
    best_first = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col(id_col))
    both = hits.unionByName(rest).withColumn("rank", F.row_number().over(best_first).cast("long"))
    return both.where(F.col("rank") <= k).select("qid", "rank", id_col, "similarity")


def probe_topk(members: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, n_probe: int, **kw) -> DataFrame:
    """Top-k among the vectors of each query's ``n_probe`` nearest cells.

    ``members`` carries a ``cell`` column. Of a stored index only the folders of probed cells are read.
    """
    probes = durable(nearest_cells(queries.select("qid", "qvec"), "qvec", centroids, n_probe, "probe", id_col="qid"))
    return _search_cells(members, probes, k, **kw)
