"""Top-k by inner product between a table of queries and a table of vectors.

Two exact plans answer the same question:

* **resident** - the queries and their hits fit a checked byte budget. They travel once to every executor and the
  vectors are scanned where they lie: no shuffle of the corpus, k rows per query and task come out.
* **tiled** - both sides are large. Rows meet by ``cell`` (an equality both sides must share, or one
  constant cell), and each cell is cut into vector blocks and query slabs of bounded size, so a cell
  holding a third of all rows becomes many equal tasks. Only k rows per query leave a tile.

Neither plan materialises pairs. Blocks are scored by float32 matrix products; all rows that could be
among the best, given the error bound of such a product, are scored again one pair at a time in double.
Ranks are thus exact, and equal vectors always get equal scores whatever block they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESIDENT_BYTES = 32 << 20
BLOCK_BYTES = 32 << 20
SLAB_BYTES = 32 << 20
PAIR_BYTES = 16 << 20
HIT_BYTES = 32
POOL_QUERIES = 1024
TILE_CELLS = 2_000_000
LEAST_ROWS = 4096

_HITS = "qid bigint, id bigint, prefer double, similarity double"
_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("prefer", pa.float64()), ("similarity", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=None) -> np.ndarray:
    """Rows of equal length as a matrix; other input is refused, as values would move between rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and pc.count_distinct(pc.fill_null(pc.list_value_length(column), -1)).as_py() > 1:
        raise ValueError("vectors of different lengths or null vectors in one table")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=dtype).reshape(len(column), -1 if len(column) else 0)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=m.copy(), where=length > 0)


def portion_rows(dim: int) -> int:
    """Vectors in double that fit the bytes one step of a task may copy."""
    return max(1, PAIR_BYTES // (8 * max(1, dim)))


def _lowest(bar: np.ndarray) -> np.ndarray:
    """A float32 not above ``bar`` and above minus infinity, which marks pairs that take no part."""
    with np.errstate(over="ignore"):
        below = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
    return np.maximum(below, np.finfo(np.float32).min)


class _Best:
    """The k best (query row, id, prefer, score) seen so far for each query row, pooled by 1024 queries."""

    def __init__(self, n_queries: int, k: int, floor: float | None):
        self.k = k
        self.floor = floor
        self.bar = np.full(n_queries, -np.inf if floor is None else floor)
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        self.pools = [list(empty) for _ in range(-(-n_queries // POOL_QUERIES))]

    def batches(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What was found, pool by pool; a pool is let go once it is handed on."""
        for pool in range(len(self.pools)):
            q, ids, prefer, score = self.pools[pool]
            self.pools[pool] = [q[:0], ids[:0], prefer[:0], score[:0]]
            yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(prefer), pa.array(score)], schema=_FOUND)

    def offer(self, qidx, qvec, qids, ids, prefer, vec, skip_self: bool) -> None:
        """Show vectors to the queries ``qidx`` (ascending); ``qvec`` and ``qids`` belong to all queries."""
        if not len(ids):
            return
        longest = np.sqrt(np.nanmax(np.einsum("ij,ij->i", vec, vec, dtype=np.float64)))
        reach = 2 * (qvec.shape[1] + 4) * np.finfo(np.float32).eps * (longest if np.isfinite(longest) else 1.0)
        edges = np.searchsorted(qidx, np.arange(0, len(self.bar) + POOL_QUERIES, POOL_QUERIES))
        for pool in range(len(self.pools)):
            part = qidx[edges[pool] : edges[pool + 1]]
            if not len(part):
                continue
            asked = qvec[part]
            rough = asked.astype(np.float32)
            slack = reach * np.sqrt(np.einsum("ij,ij->i", asked, asked))
            own = np.flatnonzero(np.isin(ids, qids[part])) if skip_self else ids[:0]
            rows = max(1, TILE_CELLS // len(part))
            for lo in range(0, len(ids), rows):
                tile = vec[lo : lo + rows]
                scores = rough @ tile.T
                if np.isnan(scores.max()):
                    scores[np.isnan(scores)] = -np.inf
                for at in own[np.searchsorted(own, lo) : np.searchsorted(own, lo + rows)]:
                    scores[qids[part] == ids[at], at - lo] = -np.inf
                pairs = np.flatnonzero(scores >= _lowest(self.bar[part] - slack)[:, None])
                if scores.shape[1] > self.k and len(pairs) > self.k * len(part):  # the tile's own k-th best is a higher bar
                    kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
                    pairs = np.flatnonzero(scores >= _lowest(np.maximum(self.bar[part], kth) - slack)[:, None])
                portion = portion_rows(asked.shape[1])  # equal vectors can make every pair of a tile one to merge
                for at in range(0, len(pairs), portion):
                    q, c = np.divmod(pairs[at : at + portion], len(tile))
                    exact = np.einsum("ij,ij->i", asked[q], tile[c].astype(np.float64))
                    self._merge(pool, part[q], ids[lo + c], prefer[lo + c], exact)

    def _merge(self, pool: int, q, ids, prefer, score) -> None:
        if self.floor is not None:
            keep = score >= self.floor
            q, ids, prefer, score = q[keep], ids[keep], prefer[keep], score[keep]
        new = [np.concatenate(p) for p in zip(self.pools[pool], (q, ids, prefer, score), strict=True)]
        order = np.lexsort((new[1], -new[2], -new[3], new[0]))
        new = [col[order] for col in new]
        rank = np.arange(len(new[0])) - np.searchsorted(new[0], new[0], side="left")
        last = rank == self.k - 1
        self.bar[new[0][last]] = np.maximum(self.bar[new[0][last]], new[3][last])
        self.pools[pool] = [col[rank < self.k] for col in new]


def _per_query(dim: int, k: int) -> int:
    """Bytes a query takes while it is searched for: its vector in double and its hits."""
    return 8 * dim + HIT_BYTES * k


def _resident(corpus: DataFrame, q: pa.Table, k: int, floor, skip_self: bool, normalize: bool) -> DataFrame:
    qvec = _matrix(q["qvec"], np.float64)
    payload = (
        q["qid"].to_numpy(),
        _unit(qvec) if normalize else qvec,
        np.asarray(q["cell"].to_pylist(), dtype=object),
    )
    shared = corpus.sparkSession.sparkContext.broadcast(payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qvec, qcell = shared.value
        by_cell = {c: np.flatnonzero(qcell == c) for c in set(qcell.tolist())}
        best = _Best(len(qids), k, floor)
        for b in batches:
            if not b.num_rows:
                continue
            ids, prefer = b["id"].to_numpy(), b["prefer"].to_numpy()
            vec = _matrix(b["vec"])
            cells = b["cell"].dictionary_encode()
            code = cells.indices.to_numpy(zero_copy_only=False)
            for i, cell in enumerate(cells.dictionary.to_pylist()):
                qidx = by_cell.get(cell)
                if qidx is None:
                    continue
                rows = slice(None) if len(cells.dictionary) == 1 and not cells.null_count else code == i
                best.offer(qidx, qvec, qids, ids[rows], prefer[rows], vec[rows], skip_self)
        yield from best.batches(qids)

    return corpus.mapInArrow(scan, _HITS)


def _scored_tile(vectors: pa.Table, asked: pa.Table, k: int, floor, skip_self: bool, normalize: bool) -> pa.Table:
    """The k best of one block for one slab; neither is copied as a whole: queries are taken pool by pool, vectors batch by batch."""
    found = []
    if vectors.num_rows:
        held = [(b["id"].to_numpy(), b["prefer"].to_numpy(), _matrix(b["vec"])) for b in vectors.select(["id", "prefer", "vec"]).to_batches()]
        for at in range(0, asked.num_rows, POOL_QUERIES):
            pool = asked.slice(at, POOL_QUERIES)
            qids, qvec = pool["qid"].to_numpy(), _matrix(pool["qvec"], np.float64)
            qvec = _unit(qvec) if normalize else qvec
            best = _Best(len(qids), k, floor)
            for some in held:
                best.offer(np.arange(len(qids)), qvec, qids, *some, skip_self)
            found.extend(best.batches(qids))
    return pa.Table.from_batches(found, _FOUND)


def _tiled(
    corpus: DataFrame, queries: DataFrame, dim: int, k: int, floor, skip_self: bool, normalize: bool, one_cell: bool
) -> DataFrame:
    block_rows, slab_rows = max(1, BLOCK_BYTES // (4 * dim)), max(1, SLAB_BYTES // _per_query(dim, k))
    if one_cell:  # the same cell everywhere: block numbers are constants and nothing is joined to get them
        n, n_slab = corpus.count(), max(1, -(-queries.count() // slab_rows))
        tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism  # few slabs: smaller blocks keep all cores at work
        n_block = max(1, -(-n // block_rows), min(-(-tasks // n_slab), -(-n // LEAST_ROWS)))

        def placed(side: DataFrame) -> DataFrame:
            return side.withColumn("n_block", F.lit(n_block).cast("long")).withColumn("n_slab", F.lit(n_slab).cast("long"))
    else:
        blocks = corpus.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n_block"))
        slabs = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / slab_rows).alias("n_slab"))
        grid = blocks.join(slabs, "cell")

        def placed(side: DataFrame) -> DataFrame:
            return side.join(grid, "cell")

    def span(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = (
        placed(corpus)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_block")))
        .withColumn("slab", span("n_slab"))
        .select("cell", "block", "slab", "id", "prefer", "vec")
    )
    right = (
        placed(queries)
        .withColumn("slab", F.pmod(F.xxhash64("qid"), F.col("n_slab")))
        .withColumn("block", span("n_block"))
        .select("cell", "block", "slab", "qid", "qvec")
    )

    def score(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        return _scored_tile(vectors, asked, k, floor, skip_self, normalize)

    keys = ["cell", "block", "slab"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _HITS)


def similarity_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    qid_col: str = "qid",
    qvec_col: str = "qvec",
    cell: tuple[str, str] | None = None,
    prefer: str | None = None,
    floor: float | None = None,
    skip_self: bool = False,
    normalize: bool = True,
    resident_bytes: int = RESIDENT_BYTES,
) -> DataFrame:
    """``(qid, rank, <id>, similarity)`` of the k best vectors for every query.

    ``cell=(corpus column, query column)`` restricts each query to vectors with the same value (a
    pre-filter, a mode, an index list). Ties go to the larger ``prefer``, then to the smaller id.
    """
    c_cell = F.col(cell[0]).cast("string") if cell else F.lit("")
    q_cell = F.col(cell[1]).cast("string") if cell else F.lit("")
    vectors = corpus.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(prefer).cast("double") if prefer else F.lit(0.0)).alias("prefer"),
        F.col(vec_col).alias("vec"),
        c_cell.alias("cell"),
    )
    asked = queries.where(F.col(qvec_col).isNotNull()).select(
        F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).alias("qvec"), q_cell.alias("cell")
    )
    head = asked.select(F.size("qvec").alias("d")).head()
    dim = max(1, head["d"]) if head else 1
    room = resident_bytes // _per_query(dim, k)
    fetched = asked.limit(room + 1).toArrow() if room else None
    if fetched is not None and fetched.num_rows <= room:
        hits = _resident(vectors, fetched, k, floor, skip_self, normalize)
    else:
        hits = _tiled(vectors, asked, dim, k, floor, skip_self, normalize, cell is None)
    best_first = Window.partitionBy("qid").orderBy(
        F.col("similarity").desc(), F.col("prefer").desc(), F.col("id")
    )
    return (
        hits.withColumn("rank", F.row_number().over(best_first).cast("long"))
        .where(F.col("rank") <= k)
        .select("qid", "rank", F.col("id").alias(id_col), "similarity")
    )


def postfilter(hits: DataFrame, labels: DataFrame, wanted: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Keep candidates whose label is the wanted one, then re-rank; may give fewer than k rows.

    ``labels``: (id, label) per vector, ``wanted``: (qid, label) per query.
    """
    order = Window.partitionBy("qid").orderBy("rank")
    return (
        hits.join(labels, id_col)
        .join(wanted, ["qid", "label"])
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= k)
        .select("qid", "rank", id_col, "similarity")
    )


def overlap_at_k(truth: DataFrame, found: DataFrame, k: int, queries: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Share (percent) of the true k best that an approximate result also returned, per query."""
    both = truth.join(found, ["qid", id_col], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return queries.select("qid").join(both, "qid", "left").select(
        "qid", n.alias("n_shared"), F.round(n * 100.0 / k, 2).alias("overlap_pct")
    )


def overlap_verdict(overlap: DataFrame) -> DataFrame:
    mean = F.avg("overlap_pct")
    return overlap.agg(
        F.round(mean, 4).alias("mean_pct"),
        F.min("overlap_pct").alias("min_pct"),
        F.max("overlap_pct").alias("max_pct"),
        F.when(mean >= 95, "pass").when(mean >= 80, "acceptable").otherwise("fail").alias("verdict"),
    )
