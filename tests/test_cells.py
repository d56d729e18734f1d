"""Exact search that skips cells, and the stored inverted file."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomewright.functions import vectors as V
from tomewright.operators import inverted_file as IVF
from tomewright.operators import topk as T
from tomewright.sources import sinks

SCHEMA = "vec_id bigint, embedding array<float>"


def clustered(spark, n=1200, centres=24, dim=16, spread=0.05, seed=3, hot=True):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    of = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % centres) if hot else np.arange(n) % centres
    m = (c[of] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    m[10:16] = m[9]  # equal vectors: ties go to the smaller id
    return spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], SCHEMA).repartition(4)


def asked_of(df, every=7):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def rows(hits):
    return sorted((r.qid, r["rank"], r.vec_id, round(r.similarity, 9)) for r in hits.collect())


def in_cells(df, n):
    centroids = IVF.train_cells(df, "embedding", n, rounds=3)
    return IVF.nearest_cells(df, "embedding", centroids, 1).cache(), centroids


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_pruned_rows_equal_the_exact_search(spark, spread):
    df = clustered(spark, spread=spread)
    members, centroids = in_cells(df, 30)
    balls = IVF.cell_balls(members, centroids).cache()
    for k in (1, 5, 90):
        want = rows(T.similarity_topk(df, asked_of(df), k, skip_self=True))
        assert rows(IVF.pruned_topk(members, asked_of(df), balls, k, skip_self=True)) == want


def test_on_clustered_data_no_query_visits_all_cells(spark):
    df = clustered(spark)
    members, centroids = in_cells(df, 40)
    balls = IVF.cell_balls(members, centroids).cache()
    n_cells = balls.count()
    first, second, _ = IVF.visited_cells(members, asked_of(df), balls, 5, skip_self=True)
    per_query = [r["count"] for r in first.select("qid", "probe").union(second.select("qid", "probe")).groupBy("qid").count().collect()]
    print(f"share of cells visited: {sum(per_query) / len(per_query) / n_cells:.3f}, at most {max(per_query)} of {n_cells}")
    assert max(per_query) < n_cells and sum(per_query) / len(per_query) < 0.25 * n_cells


def test_more_balls_than_fit_meet_in_tiles(spark):
    df = clustered(spark, spread=0.3)
    members, centroids = in_cells(df, 30)
    balls = IVF.cell_balls(members, centroids).cache()
    asked = asked_of(df).select("qid", "qvec", (F.col("qid") % 5 / 10.0).alias("bar"), F.array((F.col("qid") % 30).alias("c")).alias("seen"))
    key = lambda d: sorted((r.qid, r.probe) for r in d.collect())
    whole, tiled = IVF.cells_in_reach(asked, balls), IVF.cells_in_reach(asked, balls, room_bytes=0, tile_rows=7)
    assert key(whole) == key(tiled) and len(key(whole)) > 100


def test_reached_cells_leave_in_portions():
    """Without structure every query reaches every cell, and each pair carries the vector of its query."""
    rng = np.random.default_rng(5)
    dim, n, cells = 64, 2000, 400
    qvec = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * dim)), dim).cast(pa.list_(pa.float64()))
    asked = pa.record_batch({"qid": pa.array(range(n)), "qvec": qvec, "bar": pa.array(np.zeros(n)), "seen": pa.array([[i % cells] for i in range(n)])})
    held = np.arange(cells), rng.normal(size=(cells, dim)), np.full(cells, 99.0)
    before, most, seen = pa.total_allocated_bytes(), 0, []
    for b in IVF._within_reach(asked, *held):
        most = max(most, pa.total_allocated_bytes() - before)
        seen += zip(b["qid"].to_pylist(), b["probe"].to_pylist(), strict=True)
    assert most < 64 << 20  # all 800,000 pairs at once take 400 MB
    assert len(seen) == n * (cells - 1) == len(set(seen)) and all(c != q % cells for q, c in seen)


def test_balls_hold_all_members(spark):
    df = clustered(spark)
    members, centroids = in_cells(df, 12)
    mat = {r.cell: np.array(r.centroid) for r in centroids.collect()}
    far, size = {}, {}
    for r in members.collect():
        far[r.cell] = max(far.get(r.cell, 0.0), float(np.linalg.norm(np.array(r.embedding, np.float64) - mat[r.cell])))
        size[r.cell] = size.get(r.cell, 0) + 1
    got = {r.cell: r for r in IVF.cell_balls(members, centroids).collect()}
    assert {c: r.n_members for c, r in got.items()} == size
    assert all(got[c].radius == pytest.approx(x, abs=1e-12) for c, x in far.items())


def test_edges(spark):
    df = clustered(spark, n=40)
    members, centroids = in_cells(df, 5)
    balls = IVF.cell_balls(members, centroids)
    none = asked_of(df).where("qid < 0")
    assert IVF.pruned_topk(members, none, balls, 3).count() == 0
    one = asked_of(df).where("qid = 7")
    assert rows(IVF.pruned_topk(members, one, balls, 99, skip_self=True)) == rows(T.similarity_topk(df, one, 99, skip_self=True))
    empty = IVF.cell_balls(members.limit(0), centroids)
    assert empty.count() == 0


def test_a_stored_index_prunes_folders_at_run_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 100)
    df = clustered(spark)
    members, centroids = in_cells(df, 20)
    sinks.write_index(members, centroids, str(tmp_path))
    stored, cells = sinks.read_index(spark, str(tmp_path))
    assert stored.count() == 1200 and dict(stored.dtypes)["cell"] == "bigint"
    hot = stored.groupBy("cell").agg(F.countDistinct("slice").alias("s"), F.count("*").alias("n")).orderBy(F.desc("n")).first()
    assert hot.s == -(-hot.n // 100) >= 2
    asked = asked_of(df, every=400)
    hits = IVF.probe_topk(stored, asked, cells, 5, 2, skip_self=True)
    want = IVF.probe_topk(members, asked, centroids, 5, 2, skip_self=True)
    assert rows(hits) == rows(want)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan
    # an exact search reads few folders, too
    exact = IVF.pruned_topk(stored, asked, cells, 5, skip_self=True)
    assert rows(exact) == rows(T.similarity_topk(df, asked, 5, skip_self=True))


def test_training_stores_each_round(spark):
    df = clustered(spark, n=300)
    centres = IVF.train_cells(df, "embedding", 6, rounds=3)
    assert "Scan ExistingRDD" in centres._jdf.queryExecution().executedPlan().toString()
    assert V.group_means(IVF.nearest_cells(df, "embedding", centres, 1), "embedding", "cell").count() <= 6
