"""Every stage of the pipeline against a brute-force version of its decision, and the whole run."""

import test_bpe
import test_ngram_join
import test_secret_scan

import corpus_pipeline as P
from tomewright.llm import quality
from tomewright.llm.catalog import queries
from tomewright.llm.common import table


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    steps = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, data).cache()
        steps.append((name, docs, out))
        docs = out
    assert [n for n, _, _ in steps] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    assert all(out.columns == columns for _, _, out in steps[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    _, before, after = steps[0]
    scores = quality.score_documents(before, quality.train(before, table(spark, data, "labels"))).collect()
    assert ids(after) == {r.doc_id for r in scores if r.score >= 0.3} and len(ids(after)) < len(ids(before))

    _, before, after = steps[1]
    assert ids(after) == {i for i, c, _, _ in test_ngram_join.by_hand(list(texts(before).items())) if i == c}

    _, before, after = steps[2]
    items = [" ".join(r.text.split()) for r in table(spark, data, "benchmark").collect()]
    assert ids(after) == {i for i, t in texts(before).items() if not any(b in " ".join(t.split()) for b in items)}

    _, before, after = steps[3]
    old, new = texts(before), texts(after)
    changed = {i for i in old if old[i] != new[i]}
    assert set(new) == set(old) and {i for i, t in old.items() if test_secret_scan.base_by_hand(t)} <= changed
    assert not [i for i, t in new.items() if test_secret_scan.base_by_hand(t)]
    assert all(r.n_chars == len(r.text) for r in after.collect())

    _, before, after = steps[4]
    old = texts(before)
    for r, (want, _) in zip(rows := after.collect(), test_bpe.expected([old[r.doc_id] for r in rows])):
        assert list(r.ids) == want
    assert len(rows) == len(old)


def test_run_is_the_registered_query(spark, data):
    a = {(r.doc_id, r.ids_sha256) for r in P.run(spark, data).collect()}
    b = {(r.doc_id, r.ids_sha256) for r in queries()["pipeline"](spark, data).collect()}
    assert a and a == b and P.ORACLE_SQL is None
