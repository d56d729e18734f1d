import zlib

import numpy as np
from fixtures import EDGE, docs, prose

from tomewright.llm import quality as Q
from tomewright.llm.catalog import queries

LABELS = "doc_id bigint, quality int, toxic int"


def junk(seed):
    return " ".join(w.upper() + "!!" for w in prose(seed, 60).split())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op3_quality_votes"](spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[x.doc_id], x.quality) for x in labels if got[x.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95


def test_blocked_votes_equal_plain_ones():
    rng = np.random.default_rng(1)
    texts = [prose(k, 30) for k in range(40)] + [junk(k) for k in range(20)]
    counts = Q.term_counts(texts, Q.TermCodes())
    model = Q.fit(counts, np.array([1.0] * 40 + [0.0] * 20), dims=8, k=5)
    got = model.score(counts, block=7)
    latent = model.latent(counts).astype(np.float64)
    for row in rng.choice(60, 20, replace=False):
        cos = [float(np.float32(latent[row]) @ v) for v in model.vectors]
        near = np.argsort(cos)[::-1][:5]
        w = [max(0, min(1, cos[n])) ** model.power for n in near]
        want = (sum(a * model.labels[n] for a, n in zip(w, near)) + model.prior) / (sum(w) + 1)
        assert abs(got[row] - want) < 1e-3


def test_training_ignores_held_out_rows_order_and_repeats(spark):
    rows = [(i, prose(i, 40) if i % 3 else junk(i)) for i in range(60)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    df = docs(spark, rows)

    def scores(d, lab):
        model = Q.train(d, spark.createDataFrame(lab, LABELS))
        return {r.doc_id: round(r.score, 5) for r in Q.score_documents(df, model).collect()}

    plain = scores(df, labels)
    assert plain == scores(df, flipped)
    assert plain == scores(df.orderBy("text"), labels + labels[:7] + [(None, 1, 0), (3, None, 0), (999, 1, 0)])


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    model = Q.train(docs(spark, [(i, prose(i, 20)) for i in range(20)]), labels)
    for extra in (False, True):
        got = Q.score_documents(docs(spark, EDGE, extra), model).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {model.prior}
        kept = Q.keep_quality(docs(spark, EDGE, extra), model, threshold=0.0)
        assert kept.count() == len(EDGE) and kept.columns == docs(spark, EDGE, extra).columns
    assert Q.score_documents(docs(spark, []), model).count() == 0
    none = Q.train(docs(spark, []), spark.createDataFrame([], LABELS))
    assert {r.score for r in Q.score_documents(docs(spark, EDGE), none).collect()} == {0.5}
