import json
import os

import numpy as np
from pyspark.sql import functions as F

from tomewright.operators import context as C
from tomewright.operators import embed as E
from tomewright.operators import stateful as ST
from tomewright.operators import stats
from tomewright.operators.ordered import ordered_parts
from tomewright.plans import ingest
from tomewright.sources import files, sinks
from tomewright.streaming import keyed


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_corpus_books_chapters_months(spark, tmp_path):
    root = str(tmp_path / "a b+c")
    put(f"{root}/bg/x/1.txt", "one")
    put(f"{root}/.hid/2.txt", "no")
    put(f"{root}/loose.txt", "no")
    got = files.read_books(spark, root).collect()
    assert [(r.book, r.rel, r.text) for r in got] == [("bg", "bg/x/1.txt", "one")]
    put(f"{root}/ch/chapter_02/v01.txt", "v")
    put(f"{root}/ch/chapter_19/v01.txt", "v")
    put(f"{root}/ch/chapter_02/note.txt", "n")
    assert [(r.chapter, r.verse) for r in files.read_chapters(spark, f"{root}/ch").collect()] == [(2, "v01")]
    put(f"{root}/m/1975/conversations_1975_may.txt", "m")
    put(f"{root}/m/1977/conversations_1977_jun.txt", "m")
    assert [(r.year, r.month) for r in files.read_month_files(spark, f"{root}/m", 1974, 1976).collect()] == [(1975, "may")]
    put(f"{root}/au/chapter_03/a.mp3", "12345")
    assert [(r.chapter, r.bytes) for r in files.media_inventory(spark, f"{root}/au").collect()] == [(3, 5)]


def test_envelopes_shards_vectors_faq(spark, tmp_path):
    chunk = {"chunk_id": 0, "text": "t", "embedding": [1.0, 2.0]}
    put(f"{tmp_path}/e/bg_embeddings.json", json.dumps({"model": "m", "chunks": [chunk, {**chunk, "chunk_id": "x_1"}]}, indent=1))
    put(f"{tmp_path}/e/sb_embeddings.json", json.dumps({"scripture": "SB", "complete": True, "chunks": [chunk]}))
    put(f"{tmp_path}/e/part_a.json", json.dumps({"scripture": "no", "chunks": [chunk]}))
    got = sorted((r.scripture, r.complete, r.chunk_id, r.position) for r in files.read_envelopes(spark, f"{tmp_path}/e").collect())
    assert got == [("SB", True, "0", 0), ("bg", False, "0", 0), ("bg", False, "x_1", 1)]
    shards = files.read_shards(spark, [f"{tmp_path}/e/none.json", f"{tmp_path}/e/part_a.json"])
    assert [(r.shard, r.scripture) for r in shards.collect()] == [(1, "no")]
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    m.tofile(f"{tmp_path}/vectors.bin")
    rows = files.read_vector_file(spark, f"{tmp_path}/vectors.bin", 3).orderBy("vec_id").collect()
    assert [r.embedding for r in rows] == m.tolist()
    faq = [{"question": " Who? ", "answer_text": "1", "passages": []}, {"question": "who?", "answer_text": "2", "passages": []}]
    put(f"{tmp_path}/faq.json", json.dumps(faq))
    assert [(r.faq_key, r.answer_text) for r in files.load_faq(spark, f"{tmp_path}/faq.json").collect()] == [("who?", "2")]


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "book string, n bigint, text string")
    sinks.write_books(ordered_parts(df, "book", "n", "text"), f"{base}/books")
    assert {(r.book, r.text) for r in spark.read.parquet(f"{base}/books").collect()} == {("a", "x\n\ny"), ("b", "z")}
    emb = spark.createDataFrame([("a", 1), ("b", 1)], "scripture string, chunk_id int")
    sinks.write_embeddings(emb, f"{base}/emb", False)
    sinks.write_embeddings(emb.where("scripture = 'a'"), f"{base}/emb", True)
    assert {(r.scripture, r.complete) for r in spark.read.parquet(f"{base}/emb").collect()} == {("a", True), ("b", False)}
    letters = spark.createDataFrame([("M", None, None, "u", "hi", None)], "recipient string, date string, location string, url string, content string, year string")
    sinks.write_letters(letters, f"{base}/letters")
    row = spark.read.parquet(f"{base}/letters").first()
    assert row.year == "unknown" and row.text.startswith("LETTER TO: M\nDATE: Unknown\nLOCATION: Unknown\nURL: u\n===")
    for _ in range(2):
        sinks.append_waitlist(spark.createDataFrame([("x@y.org", None)], "email string, user_id string"), f"{base}/waitlist")
        sinks.append_cost_log(stats.cost_entries(df, "book", "text"), f"{base}/cost_json", f"{base}/cost_csv")
    assert files.read_store(spark, base, "waitlist").select(F.count_distinct("id")).first()[0] == 2
    assert spark.read.option("header", True).csv(f"{base}/cost_csv").count() == 6


def test_ingest_and_search(spark, tmp_path):
    for i in range(12):
        put(f"{tmp_path}/in/book{i % 3}/{i}.txt", f"topic{i} words about topic{i} here. Donate\nmore on topic{i} and topic{i}. end")
    out = str(tmp_path / "out")
    ingest.build_index(spark, str(tmp_path / "in"), out, n_cells=3, embed_fn=E.hashed_words(1024))
    asked = E.embed_texts(spark.createDataFrame([(8, "more on topic8 and topic8.")], "qid bigint, question string"), "question", E.hashed_words(1024), out="qvec")
    hits = ingest.search_index(spark, out, asked, 2, n_probe=3).orderBy("rank").collect()
    assert "topic8" in hits[0].text and hits[0].scripture == "book2"
    corpus = spark.read.parquet(f"{out}/embeddings").select("vec_id", "embedding")
    faq = ingest.seed_faq(asked, corpus, spark.read.parquet(f"{out}/chunks"), 2)
    row = faq.first()
    assert "[Passage 1]" in row.answer_text and len(row.passages) == 2
    sinks.write_faq(faq, f"{out}/faq")
    plan = spark.read.parquet(f"{out}/index/vectors").where("cell = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_embedder_batches_retries_and_generator(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    assert E.with_retries(flaky, ["ab"], 3, 0.0) == [[2.0]] and calls == [1, 1]
    ctx = spark.createDataFrame([(1, "few words")], "qid int, context string")
    got = E.generate_answers(ctx, lambda p: p, concise=True, retry_note="again").first()
    assert got.answer == "few words\n\nagain"


def test_passage_json(spark):
    df = spark.createDataFrame([("[{\"scripture\":\"a\",\"similarity\":0.5}]",), ("[{\"scripture\":",), (None,), ("",)], "j string")
    assert [len(r.p) for r in df.select(C.decode_passages(F.col("j")).alias("p")).collect()] == [1, 0, 0, 0]


def _stream(spark, tmp_path, rows):
    """Events as a stream of two files in order of time."""
    src = f"{tmp_path}/src"
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, at bigint, failed boolean").withColumn("ts", F.timestamp_micros("at"))
    cut = sorted(r[2] for r in rows)[len(rows) // 2]
    for part in (F.col("at") < cut, F.col("at") >= cut):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _drain(spark, stream, tmp_path, name):
    q = (
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}_c")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_streams_decide_like_batches(spark, tmp_path):
    from test_stateful import breaker_model, events, limiter_model

    rows = events(9, 300, 2000)
    stream = _stream(spark, tmp_path, rows)
    kw = {"key": "user_id", "ts": "ts", "id_col": "event_id", "flag": "failed", "delay": "1 hour"}
    got = _drain(spark, keyed.decide_stream(stream, ST.Limiter(3, 60).step, idle_s=120, **kw), tmp_path, "lim")
    assert {r.id: r.decision for r in got.collect()} == limiter_model(rows, 3, 60)
    got = _drain(spark, keyed.decide_stream(stream, ST.Breaker(2, 60, 300).step, **kw), tmp_path, "brk")
    assert {r.id: r.decision for r in got.collect()} == breaker_model(rows, 2, 60, 300)
    got = _drain(spark, keyed.decide_stream(stream, keyed.Quota(2).step, **kw), tmp_path, "quo")
    batch = spark.createDataFrame(rows, "id bigint, user bigint, at bigint, kept boolean").withColumn("quota", F.lit(2))
    want = ST.quota_ledger(batch, by=["user"], order=["at", "id"], quota="quota", kept="kept")
    assert {r.id: r.decision for r in got.collect()} == {r.id: r.decision for r in want.collect()}


def test_incremental_ingest_and_cache(spark, tmp_path):
    src, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    put(f"{src}/a/1.txt", "one\nDonate")
    keyed.ingest_new_files(spark, src, out, ck, ["Donate"])
    put(f"{src}/b/2.txt", "two")
    keyed.ingest_new_files(spark, src, out, ck, ["Donate"])
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"]
    schema = "id bigint, question string, last_used_at timestamp"
    stamp = F.timestamp_seconds(F.col("id"))
    for lo in (0, 4):
        rows = spark.range(lo, lo + 4).select("id", F.lit("q").alias("question"), stamp.alias("last_used_at"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/ans")
        keyed.maintain_answer_cache(spark.readStream.schema(schema).parquet(f"{tmp_path}/ans"), f"{tmp_path}/cache", f"{tmp_path}/cck", n=5)
    assert sorted(r.id for r in keyed.current_cache(spark, f"{tmp_path}/cache", 99).collect()) == [3, 4, 5, 6, 7]


def test_cache_versions_are_pointed_to_replayed_and_removed(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert keyed.current_cache(spark, path) is None and keyed.cache_versions(spark, path) == []

    def batch(*rows):
        return spark.createDataFrame(rows, "id bigint, answer string, last_used_at bigint")

    def now(below=None):
        return sorted(tuple(r) for r in keyed.current_cache(spark, path, below).collect())

    for number in range(6):
        keyed.merge_answers(batch((number, "new", 10 * number), (100, f"refreshed {number}", 10 * number + 5)), path, number, n=3)
        assert [r[1] for r in now() if r[0] == 100] == [f"refreshed {number}"]
        assert len(keyed.cache_versions(spark, path)) <= 3
    assert keyed.cache_versions(spark, path) == [3, 4, 5]
    want = now()
    assert [r[0] for r in want] == [4, 5, 100]
    keyed.merge_answers(batch((5, "new", 50), (100, "refreshed 5", 55)), path, 5, n=3)  # run again
    assert now() == want and keyed.cache_versions(spark, path) == [3, 4, 5]
    left = [x for x in os.listdir(path) if not x.startswith(".")]
    assert sorted(left) == ["_current", "version=3", "version=4", "version=5"]


def test_faq_as_array_and_as_lines(spark, tmp_path):
    put(f"{tmp_path}/a.json", '[\n {"question": " Who? ", "answer_text": "a", "passages": []},\n {"question": "WHO?", "answer_text": "b", "passages": []},\n {"question": "x", "answer_text": "c", "passages": []}]')
    assert {(r.faq_key, r.answer_text) for r in files.load_faq(spark, f"{tmp_path}/a.json").collect()} == {("who?", "b"), ("x", "c")}
    sinks.write_faq(files.load_faq(spark, f"{tmp_path}/a.json").coalesce(1), f"{tmp_path}/lines")
    assert {(r.faq_key, r.answer_text) for r in files.load_faq(spark, f"{tmp_path}/lines").collect()} == {("who?", "b"), ("x", "c")}
    sinks.write_faq(files.load_faq(spark, f"{tmp_path}/a.json").where("false"), f"{tmp_path}/none")
    assert files.load_faq(spark, f"{tmp_path}/none").count() == 0
