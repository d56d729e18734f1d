from pyspark.sql import functions as F

from tomewright.operators import accounts as A
from tomewright.operators import caches as C
from tomewright.operators import stats as S


def test_quota_gate(spark):
    users = spark.createDataFrame([(1, 3, 0)], "user_id int, text_quota int, voice_quota int")
    asked = spark.createDataFrame([(1, "text"), (1, "voice"), (2, "text")], "user_id int, mode string")
    got = {(r.user_id, r.mode): (r.remaining, r.used) for r in A.quota_gate(asked, users, "user_id", "mode").collect()}
    assert got == {(1, "text"): (3, 2), (1, "voice"): (0, 2), (2, "text"): (0, 5)}


def test_upsert_keeps_ids_and_quotas(spark):
    old = spark.createDataFrame([("g1", "id1", "a@x", 1), ("g2", "id2", "b@x", 4)], "google_id string, id string, email string, text_quota int")
    new = spark.createDataFrame([("g2", None), ("g3", "c@x")], "google_id string, email string")
    got = A.upsert(old, new, "google_id", ["email"], {"id": F.lit("new"), "text_quota": F.lit(5)}).collect()
    assert sorted(tuple(r) for r in got if r.google_id != "g2") == [("g1", "id1", "a@x", 1), ("g3", "new", "c@x", 5)]
    assert [tuple(r) for r in got if r.google_id == "g2"] == [("g2", "id2", None, 4)]


def test_resume_and_batches(spark):
    chunks = spark.createDataFrame([(b, i) for b in "abc" for i in range(5)], "book string, n bigint")
    done = spark.createDataFrame([("a", 3, False), ("b", 0, True)], "book string, done int, complete boolean")
    assert sorted((r.book, r.n) for r in A.resume(chunks, done, "book", "n").collect()) == [
        ("a", 3), ("a", 4), *[("c", i) for i in range(5)]
    ]
    plan = A.batch_plan(chunks.where("book = 'a'"), "book", "n", 1, 2).orderBy("batch").collect()
    assert [r.checkpoint for r in plan] == [False, True, False, True, True]


def test_selection_and_recent(spark):
    clips = spark.createDataFrame([(i, 3_600_000) for i in range(3)], "n int, ms bigint")
    row = S.selection_summary(clips, "ms").first()
    assert row.n_clips == 3 and row.verdict == "ok" and abs(row.hours - 3 - 1000 / 3.6e6) < 1e-9
    assert S.selection_summary(clips.where("n < 0"), "ms").first().verdict == "short"
    assert [r.n for r in S.recent_entries(clips, "n", 2).collect()] == [2, 1]


def test_cache_figures(spark):
    log = spark.createDataFrame([(" A ",), ("a",), ("b",)], "q string")
    row = C.cache_stats(log, "q").first()
    assert tuple(row) == (2, 3, 1.5, 33.3, 1, 0.0012)
    assert tuple(C.cache_stats(log.where("q = 'none'"), "q").first()) == (0, 0, 0.0, 0.0, 0, 0.0)
    kept = C.keep_most_recent(spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "id int, at int"), "at", "id", 1)
    assert [r.id for r in kept.collect()] == [2]
