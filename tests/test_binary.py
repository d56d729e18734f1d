"""Data sources of raw matrices and chunk envelopes."""

import io
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.sources import binary as B
from tomewright.sources import files, sinks


def matrix(tmp_path, n=1000, dim=7):
    m = np.random.default_rng(1).normal(size=(n, dim)).astype("<f4")
    m.tofile(f"{tmp_path}/m.f32")
    return m


@pytest.mark.parametrize("range_bytes", [1, 28 * 333, 1 << 30])
def test_matrix_is_read_in_byte_ranges(spark, tmp_path, range_bytes):
    m = matrix(tmp_path)
    df = files.read_vector_file(spark, f"{tmp_path}/m.f32", 7, range_bytes=range_bytes if range_bytes > 1 else 28 * 100)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == {1: 10, 28 * 333: 4, 1 << 30: 1}[range_bytes]
    assert sorted(r.vec_id for r in rows) == list(range(1000))
    assert all(np.array_equal(np.array(r.embedding, np.float32), m[r.vec_id]) for r in rows)


def test_matrix_round_trip_and_refusals(spark, tmp_path):
    m = matrix(tmp_path)
    df = spark.createDataFrame([(5 * i, m[i].tolist()) for i in range(1000)], "vec_id bigint, embedding array<float>").orderBy(F.rand(3)).repartition(6)
    sinks.write_vector_files(df, f"{tmp_path}/out", 7)
    assert all(x.endswith(".f32") for x in os.listdir(f"{tmp_path}/out"))
    back = {r.vec_id: r.embedding for r in files.read_vector_file(spark, f"file://{tmp_path}/out", 7, range_bytes=2800).collect()}
    assert len(back) == 1000 and all(np.array_equal(np.array(back[i], np.float32), m[i]) for i in range(1000))
    with pytest.raises(Exception, match="whole number of rows"):
        files.read_vector_file(spark, f"{tmp_path}/m.f32", 9).collect()
    with pytest.raises(Exception, match="has not 8 values"):
        sinks.write_vector_files(df, f"{tmp_path}/bad", 8)
    open(f"{tmp_path}/none.f32", "wb").close()
    assert files.read_vector_file(spark, f"{tmp_path}/none.f32", 7).count() == 0


def envelope(n, seed=0, **more):
    rng = random.Random(seed)
    chunks = [
        {"chunk_id": f"c{k}", "year": 2000 + k % 20, "text": "say \"[{}]\" é🙂 " * rng.randint(0, 9), "embedding": [rng.random() for _ in range(rng.randint(0, 5))]}
        for k in range(n)
    ]
    return {"scripture": "s", "model": "m", "total_chunks": n, "complete": True, "chunks": chunks, **more}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_parts_of_an_envelope_however_it_is_cut(monkeypatch, size):
    monkeypatch.setattr(B, "READ_CHARS", size)
    for indent in (None, 2):
        for e in (envelope(0), envelope(1), envelope(30), {"chunks": [1, -2.5e3, "x", None, [1], {}], "n": 12}, {}):
            got = list(B.envelope_parts(io.StringIO(json.dumps(e, indent=indent, ensure_ascii=False))))
            assert [v for k, v in got if k == "chunks"] == e.get("chunks", [])
            assert {k: v for k, v in got if k != "chunks"} == {k: v for k, v in e.items() if k != "chunks"}


def test_envelopes_of_every_order(spark, tmp_path, monkeypatch):
    e = envelope(700)
    late = {k: e[k] for k in ("chunks", "total_chunks", "complete", "scripture")}
    bare = {"chunks": [{"chunk_id": 5, "text": None, "month": "May", "extra": 1}, None]}
    for name, x in (("a", e), ("b", late), ("my_book", bare), ("empty", {"chunks": None})):
        with open(f"{tmp_path}/{name}_embeddings.json", "w") as f:
            json.dump(x, f)
    rows = files.read_envelopes(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.position):
        by.setdefault(os.path.basename(r.path)[0], []).append(r)
    for name in "ab":
        assert [(r.position, r.chunk_id, r.year, r.text, len(r.embedding)) for r in by[name]] == [
            (k, c["chunk_id"], c["year"], c["text"], len(c["embedding"])) for k, c in enumerate(e["chunks"])
        ]
        assert all(r.scripture == "s" and r.complete for r in by[name])
    assert [(r.scripture, r.complete, r.chunk_id, r.text, r.month) for r in by["m"]] == [("my_book", False, "5", None, "May"), ("my_book", False, None, None, None)]
    assert "e" not in by


def test_a_broken_envelope_is_named(spark, tmp_path):
    with open(f"{tmp_path}/x_embeddings.json", "w") as f:
        f.write(json.dumps(envelope(3))[:-20])
    with pytest.raises(Exception, match="x_embeddings.json is no chunk envelope"):
        files.read_envelopes(spark, str(tmp_path)).collect()


def test_an_envelope_larger_than_the_workers_memory(tmp_path):
    """300 MB of chunks pass a process that may hold 200 MB more than it starts with."""
    path = f"{tmp_path}/big_embeddings.json"
    piece = json.dumps({"chunk_id": "c", "text": "word " * 12_000, "embedding": [0.25] * 64})
    with open(path, "w") as f:
        f.write('{"scripture": "big", "chunks": [' + piece)
        for _ in range(4_999):
            f.write("," + piece)
        f.write('], "complete": true}')
    assert os.path.getsize(path) > 300_000_000
    code = f"""
import resource, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tomewright.sources import binary as B
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
reader = B.EnvelopeReader([{path!r}])
n = sum(b.num_rows for b in reader.read(reader.partitions()[0]))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) == 5_000 and int(grown) < 200
