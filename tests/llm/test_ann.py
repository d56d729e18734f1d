import numpy as np
from pyspark.sql import functions as F

from tomewright.llm import ann
from tomewright.llm.catalog import queries

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        row = ids.index(q)
        score = x @ x[row]
        order = sorted((-s, i) for s, i in zip(score.tolist(), ids) if i != q)
        out[q] = order[:k]
    return out


def test_recall_of_the_query(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
        ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
        want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
        got = {}
        for r in queries()["op6_multi_index_hashing"](spark, d).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hits = 0
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == list(range(1, 21))
            assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
            assert all(abs(s - x[ids.index(q)] @ x[ids.index(i)]) < 1e-12 for _, i, s in found)
            hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
        assert hits / (20 * len(want)) >= 0.9


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[:50] = codes[0] ^ (np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64))
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 7, 8, 20, 25, 31, 40, 64):
        for code in codes[:5]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_lengths_ties_shards_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32) * rng.uniform(0.1, 5, (700, 1)).astype(np.float32)
    x[100:300] = 50 * x[100] / np.linalg.norm(x[100])  # many equal vectors, the longest of all
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0), (2060, [None] + [1.0] * 15, 0), (2080, [float("inf")] + [1.0] * 15, 0),
           (None, [1.0] * 16, 0), (2100, [], 0), (2120, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad + rows[:3], VECTORS).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y")).withColumn("asked", F.lit("z"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=200, slab_rows=10).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(list(range(700)), x.astype(np.float64), range(0, 700, 20), 20)
    assert set(got) == set(want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9
    for q in range(120, 300, 20):  # a query among its equals: exact scores, ties by id
        equal = [i for s, i in sorted(got[q]) if i in range(100, 300)]
        assert equal == sorted(equal) and equal[0] == 100


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 1.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert ann.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 1)], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_take_no_place_of_another_id(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    hot = np.array([1.2 * v for v in (x[0] + rng.standard_normal((50, 8)).astype(np.float32) / 100)], np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] * 2 + [(999, v.tolist(), 0) for v in hot]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 200, 20))
    hits = 0
    for q, found in got.items():
        score = {i: float(x[i].astype(float) @ x[q]) for i in range(200) if i != q} | {999: float((hot.astype(float) @ x[q]).max())}
        assert len({i for _, i, _ in found}) == 20 and all(abs(s - score[i]) < 1e-6 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(sorted(score, key=lambda i: -score[i])[:20]))
    assert got[0][0][1] == 999 and hits / (20 * len(got)) >= 0.9
