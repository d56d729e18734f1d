"""An index that takes in batches: same members and cells as at once, unchanged cells untouched, drift and retraining."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cells import SCHEMA, asked_of, clustered, rows

from tomewright.operators import inverted_file as IVF
from tomewright.operators import topk as T
from tomewright.plans import living_index as L


def content(spark, path):
    members, balls = L.read(spark, path)
    cells = {(r.vec_id, r.cell, tuple(r.embedding)) for r in members.collect()}
    return cells, {r.cell: (round(r.radius, 9), r.n_members) for r in balls.collect()}


def files(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(f"{path}/vectors") for f in names if f.startswith("part-")}


def test_two_ingests_equal_one_and_search_is_exact(spark, tmp_path):
    df = clustered(spark, n=400).cache()
    part = F.col("vec_id") % 4
    paths = [str(tmp_path / x) for x in ("twice", "once")]
    for path in paths:
        L.build(df.where(part < 2), path, 12)
    L.ingest(df.where(part == 2), paths[0])
    L.ingest(df.where(part == 3), paths[0])
    L.ingest(df.where(part >= 2), paths[1])
    assert content(spark, paths[0]) == content(spark, paths[1])
    members, balls = L.read(spark, paths[0])
    assert rows(IVF.pruned_topk(members, asked_of(df), balls, 5, skip_self=True)) == rows(T.similarity_topk(df, asked_of(df), 5, skip_self=True))
    with pytest.raises(ValueError):
        L.build(df, paths[0], 12)


def test_new_vectors_replace_old_ones_and_other_cells_stay(spark, tmp_path):
    df, path = clustered(spark, n=200, hot=False).cache(), str(tmp_path / "i")
    L.build(df, path, 10)
    before, _ = content(spark, path)
    old = files(path)
    target = df.where("vec_id = 9").first().embedding
    batch = spark.createDataFrame([(7, target), (7, target), (900, target), (901, None), (None, target)], SCHEMA)
    L.ingest(batch, path)
    after, balls = content(spark, path)
    assert all(files(path)[f] == t for f, t in old.items())
    home = {c for v, c, _ in before if v == 9}
    assert {c for v, c, _ in after if v in (7, 900)} == home
    assert {x for x in after if x[0] not in (7, 900)} == {x for x in before if x[0] != 7}
    assert len(after) == 201 == sum(n for _, n in balls.values())
    touched = {int(f.split("cell=")[1].split("/")[0]) for f in set(files(path)) - set(old)}
    assert touched == home | {c for v, c, _ in before if v == 7}
    L.ingest(batch.limit(0), path)
    assert content(spark, path)[0] == after


def test_pieces_are_merged_versions_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MAX_PIECES", 2)
    df, path = clustered(spark, n=120, hot=False).cache(), str(tmp_path / "i")
    L.build(df.where("vec_id < 20"), path, 3)
    for k in range(1, 6):
        L.ingest(df.where(F.col("vec_id").between(20 * k, 20 * k + 19)), path, max_drift=9.0)
    pieces, _ = L._tables(spark, path, 6)
    assert pieces.groupBy("cell").count().agg(F.max("count")).first()[0] <= 2
    assert {v for v, _, _ in content(spark, path)[0]} == set(range(120))
    assert L.versions.started(spark, path) == [4, 5, 6]
    for n in (4, 5):
        members, balls = L.read(spark, path, n)
        assert members.count() == 20 * n == balls.agg(F.sum("n_members")).first()[0]


def test_drift_calls_for_new_centres(spark, tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path / "i")
    near = lambda axis, ids: spark.createDataFrame(
        [(i, (np.eye(8)[axis] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist()) for i in ids], SCHEMA
    )
    L.build(near(0, range(30)), path, 2)
    assert L.ingest(near(0, range(30, 60)), path) < 0.05
    assert L._tables(spark, path, 2)[1].agg(F.max("base_drift")).first()[0] < 0.05
    calm = [tuple(r.centroid) for r in L.read(spark, path)[1].orderBy("cell").collect()]
    assert L.ingest(near(5, range(60, 200)), path) < 0.1
    members, balls = L.read(spark, path)
    assert [tuple(r.centroid) for r in balls.orderBy("cell").collect()] != calm and members.count() == 200
