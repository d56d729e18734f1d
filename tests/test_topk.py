import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomewright.functions import vectors as V
from tomewright.operators import inverted_file as IVF
from tomewright.operators import topk as T

SCHEMA = "vec_id bigint, embedding array<float>, label int, fresh double"


def make(n=400, dim=8, seed=1, hot=True):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.where(np.arange(n) % 3 == 0, 7, np.arange(n) % 11) if hot else np.arange(n) % 11
    m[label == 7] = np.where((np.arange(n)[label == 7] % 2 == 0)[:, None], m[0], m[label == 7])  # many equal copies
    return [(i, m[i].tolist(), int(label[i]), float(i % 5)) for i in range(n)]


def brute(rows, k, cell=False, floor=None, prefer=False):
    out = {}
    mat = np.array([r[1] for r in rows], dtype=np.float64)
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    for i, r in enumerate(rows):
        s = np.einsum("ij,ij->i", np.repeat(unit[i][None], len(rows), 0), mat)
        cand = [
            (-s[j], -rows[j][3] if prefer else 0, rows[j][0])
            for j in range(len(rows))
            if j != i and (not cell or rows[j][2] == r[2]) and (floor is None or s[j] >= floor)
        ]
        out[r[0]] = [c[2] for c in sorted(cand)[:k]]
    return out


def run(spark, rows, k, resident, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    hits = T.similarity_topk(df, asked, k, skip_self=True, resident_bytes=T.RESIDENT_BYTES if resident else 0, **kw)
    got = {r[0]: [] for r in rows}
    for h in sorted(hits.collect(), key=lambda h: (h.qid, h.rank)):
        got[h.qid].append(h.vec_id)
    return got


@pytest.mark.parametrize("resident", [True, False])
@pytest.mark.parametrize(
    "kw,model",
    [
        ({}, {}),
        ({"cell": ("label", "label")}, {"cell": True}),
        ({"floor": 0.4, "prefer": "fresh"}, {"floor": 0.4, "prefer": True}),
    ],
)
def test_both_plans_equal_brute_force(spark, monkeypatch, resident, kw, model):
    monkeypatch.setattr(T, "BLOCK_BYTES", 30 * 4 * 8)
    monkeypatch.setattr(T, "SLAB_BYTES", 25 * 8 * 8)
    monkeypatch.setattr(T, "POOL_QUERIES", 64)
    monkeypatch.setattr(T, "TILE_CELLS", 2000)
    rows = make()
    assert run(spark, rows, 6, resident, **kw) == brute(rows, 6, **model)


def test_hot_cell_is_cut_into_bounded_tiles(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 20 * 4 * 8)
    rows = make(300)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    hits = T.similarity_topk(df, asked, 2, cell=("label", "label"), resident_bytes=0)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_resident_plan_never_shuffles_the_corpus(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    plan = T.similarity_topk(df, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # one exchange, above the scan of the corpus
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


def test_full_probe_has_full_recall_and_recall_grows(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    centroids = IVF.train_cells(df, "embedding", 8)
    members = IVF.nearest_cells(df, "embedding", centroids, 1).cache()
    truth = T.similarity_topk(df, asked, 5, skip_self=True).cache()
    means = []
    for n in (1, 4, 8):
        found = IVF.probe_topk(members, asked, centroids, 5, n, skip_self=True)
        means.append(T.overlap_verdict(T.overlap_at_k(truth, found, 5, asked)).first())
    assert means[0].mean_pct <= means[1].mean_pct <= means[2].mean_pct == 100.0
    assert means[2].verdict == "pass"


def test_cache_threshold_on_near_copies(spark):
    base = np.eye(4, dtype=np.float32)
    near = base[0] * 0.95 + base[1] * 0.3
    rows = [(0, base[0].tolist(), 0, 0.0), (1, (near / np.linalg.norm(near)).tolist(), 0, 0.0), (2, base[2].tolist(), 0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = T.similarity_topk(df, asked, 1, floor=0.92, skip_self=True).collect()
    assert sorted((h.qid, h.vec_id) for h in got) == [(0, 1), (1, 0)]


def test_normalise_zero_vector(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id int, v array<float>")
    keep = {r.id: r.v for r in V.l2_normalize(df, "v").collect()}
    assert keep[0] == [0.0, 0.0] and keep[1] == pytest.approx([0.6, 0.8])
    assert all(np.isnan(x) for x in {r.id: r.v for r in V.l2_normalize(df, "v", "nan").collect()}[0])


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(0, [1.5, -2.25])], "id int, v array<float>")
    assert df.select(V.decode_f32(V.encode_f32("v")).alias("v")).first().v == [1.5, -2.25]


def test_no_queries_give_no_hits(spark):
    df = spark.createDataFrame(make(20), SCHEMA)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")).where("qid < 0")
    assert T.similarity_topk(df, asked, 3).count() == 0


def test_tiles_of_one_cell_need_no_join(spark):
    df = spark.createDataFrame(make(60), SCHEMA)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    plan = T.similarity_topk(df, asked, 2, resident_bytes=0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_more_cells_than_fit(spark):
    df = spark.createDataFrame(make(300), SCHEMA)
    cells = spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in make(90, seed=5, hot=False)], "cell bigint, centroid array<double>")
    few = IVF.nearest_cells(df, "embedding", cells, 3)
    many = IVF.nearest_cells(df, "embedding", cells, 3, room_bytes=8 * 8 * 10)
    key = lambda d: sorted((r.vec_id, r.cell) for r in d.collect())
    assert key(few) == key(many) and len(key(few)) == 900


def test_vectors_of_other_lengths_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0] * 5)], "id bigint, vec array<float>").coalesce(1)
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0])], "qid bigint, qvec array<float>")
    with pytest.raises(Exception, match="different lengths|shapes|mismatch|matmul"):
        T.similarity_topk(vectors.withColumnsRenamed({"id": "vec_id", "vec": "embedding"}), asked, 1).collect()


def numpy_peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def arrow_tile(n_vectors, n_asked, dim, seed=3):
    rng = np.random.default_rng(seed)

    def lists(n):
        return pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * dim).astype(np.float32)), dim).cast(pa.list_(pa.float32()))

    some = pa.table({"id": np.arange(n_vectors), "prefer": np.zeros(n_vectors), "vec": lists(n_vectors)})
    vectors = pa.Table.from_batches(some.to_batches(max_chunksize=10_000))
    return vectors, pa.table({"qid": np.arange(n_asked), "qvec": lists(n_asked)})


def test_pairs_of_equal_vectors_are_scored_in_portions():
    same, asked = np.ones((2000, 64), np.float32), np.ones((512, 64))
    best = T._Best(512, 3, None)
    offer = lambda: best.offer(np.arange(512), asked, np.arange(512), np.arange(2000), np.zeros(2000), same, False)
    assert numpy_peak(offer) < 250  # all million pairs at once take 1,000 MB
    assert [b["id"].to_pylist() for b in best.batches(np.arange(512))] == [[0, 1, 2] * 512]


def test_a_full_tile_takes_little_memory():
    dim = 1024
    vectors, asked = arrow_tile(T.BLOCK_BYTES // (4 * dim), T.SLAB_BYTES // T._per_query(dim, 5), dim)
    before = pa.total_allocated_bytes()
    held = []
    peak = numpy_peak(lambda: held.append(T._scored_tile(vectors, asked, 5, None, False, True)))
    size = (vectors.nbytes + asked.nbytes + pa.total_allocated_bytes() - before) >> 20
    assert peak + size < 350
    assert held[0].num_rows == 5 * asked.num_rows


def test_many_cells_are_scored_in_portions(spark, monkeypatch):
    monkeypatch.setattr(IVF, "TILE_CELLS", 200)
    df = spark.createDataFrame(make(300), SCHEMA)
    cells = spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in make(90, seed=5, hot=False)], "cell bigint, centroid array<double>")
    near = IVF.nearest_cells(df, "embedding", cells, 3)
    mat = np.array([r[1] for r in make(90, seed=5, hot=False)])
    want = {(r[0], int(c)) for r in make(300) for c in np.argsort(-(np.array(r[1], np.float32).astype(float) @ mat.T), kind="stable")[:3]}
    assert {(r.vec_id, r.cell) for r in near.collect()} == want


def test_hits_count_in_the_budget_of_queries(spark):
    """Many hits a query must not pile up in tasks: such a batch is cut into slabs, though its vectors alone would fit."""
    df = spark.createDataFrame(make(100), SCHEMA)
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    plan = lambda k: T.similarity_topk(df, asked, k, resident_bytes=100 * (8 * 8 + 32 * 5))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan(5) and "CoGroup" not in plan(5)
    assert "CoGroup" in plan(50)


def test_tied_pairs_of_a_full_tile_are_merged_in_portions():
    same, asked = np.ones((T.TILE_CELLS // T.POOL_QUERIES, 64), np.float32), np.ones((T.POOL_QUERIES, 64))
    ids = np.arange(len(same))[::-1].copy()
    best = T._Best(len(asked), 3, None)
    offer = lambda: best.offer(np.arange(len(asked)), asked, np.arange(len(asked)), ids, np.zeros(len(same)), same, False)
    assert numpy_peak(offer) < 100  # two million pairs merged at once take 244 MB
    assert [b["id"].to_pylist() for b in best.batches(np.arange(len(asked)))] == [[0, 1, 2] * len(asked)]


def test_a_slab_is_not_copied_as_a_whole():
    dim = 1024
    vectors, asked = arrow_tile(2000, T.SLAB_BYTES // T._per_query(dim, 5), dim)
    held = []
    assert numpy_peak(lambda: held.append(T._scored_tile(vectors, asked, 5, None, False, True))) < 85  # all queries in double and their unit vectors take 99 MB
    assert held[0].num_rows == 5 * asked.num_rows


def test_void_numbers_and_the_own_vector_take_no_part():
    """Rows that hold no number leave the others' ranks alone, and so do ids that stand twice."""
    vectors, asked = arrow_tile(300, 40, 8)
    m = np.stack(vectors["vec"].to_numpy())
    m[[5, 77]] = np.nan
    ids = np.arange(300) // 2
    some = pa.table({"id": ids, "prefer": np.zeros(300), "vec": pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8).cast(pa.list_(pa.float32()))})
    got = T._scored_tile(some, asked, 4, None, True, True).to_pydict()
    q = np.stack(asked["qvec"].to_numpy()).astype(float)
    scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ m.astype(float).T
    scores[np.isnan(scores) | (ids[None] == np.arange(40)[:, None])] = -np.inf
    want = [(i, int(ids[j])) for i in range(40) for j in np.lexsort((ids, -scores[i]))[:4]]
    assert sorted(zip(got["qid"], got["id"], strict=True)) == sorted(want)
