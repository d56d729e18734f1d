"""Registered queries over logs, tables and corpus figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.catalog import corpus_text as CT
from tomewright.catalog.retrieval import ALL_PAIRS, FLOOR, _asked, _mode, _vectors
from tomewright.catalog.tables import table
from tomewright.functions import html as H
from tomewright.functions import text as X
from tomewright.functions import vectors as V
from tomewright.operators import accounts as A
from tomewright.operators import caches as C
from tomewright.operators import ordered as O
from tomewright.operators import stateful as ST
from tomewright.operators import stats as S
from tomewright.operators.chunk import chunk_documents
from tomewright.operators.embed import embed_texts
from tomewright.plans.cascade import best_and_cached
from tomewright.plans.cascade import route_questions as route
from tomewright.session import checkpoint_folder
from tomewright.streaming.keyed import current_cache, maintain_answer_cache

LIMIT = (3, 86_400)
BREAK = (2, 172_800, 259_200)


def _docs(spark, d):
    return CT._docs(spark, d)


def _labelled(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_semi")


def _cache(spark, d):
    log = _labelled(spark, d).withColumn("cached_id", F.col("doc_id"))
    return C.embedding_cache(log, "text", "doc_id", ["cached_id"])


def embed_cache_hits(spark, d):
    """Labelled documents are cached; every document asks."""
    return C.cache_hits(_docs(spark, d), _cache(spark, d), "text").select("doc_id", "query_hash", "cached_id")


def embed_cache_misses(spark, d):
    return C.cache_misses(_docs(spark, d), _cache(spark, d), "text").select("doc_id", "query_hash")


def embed_cache_stats(spark, d):
    return C.cache_stats(_docs(spark, d), "text")


def embed_chunks(spark, d):
    chunks = chunk_documents(_docs(spark, d).select("doc_id", "text"))
    vectors = embed_texts(chunks, "text")
    return vectors.select(
        "doc_id", "chunk_id", F.size("embedding").cast("long").alias("dim"),
        F.round(V.norm(F.col("embedding")), 4).alias("norm"),
        F.round(F.aggregate(
            F.transform("embedding", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v
        ), 5).alias("weighted"),
    )


def exact_history_hit(spark, d):
    """Labelled documents are answered history; every document asks again, padded and in mixed case."""
    stored = _labelled(spark, d).withColumn("answer_id", F.col("doc_id"))
    index = C.history_index(stored, "source", "text", "doc_id", ["answer_id"])
    asked = _docs(spark, d).select(
        "doc_id", "source", F.concat(F.lit(" \t"), F.translate("text", "aeiou", "AEIOU"), F.lit("\n ")).alias("q")
    )
    hits = C.exact_hits(asked, index, "source", "q")
    return hits.select("doc_id", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"))


def history_page(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    page = A.history_page(orders, "o_custkey", "o_orderdate", "o_orderkey", 3, 2)
    return page.select("o_custkey", "position", "o_orderkey", "o_totalprice", "total")


def _user_turns(spark, d):
    return table(spark, d, "conversations").where(F.col("role") == "user")


def _faq(spark, d):
    opening = _user_turns(spark, d).where(F.col("turn") == 0).withColumn("faq_id", F.col("conv_id"))
    return C.faq_index(opening, "text", "conv_id", ["faq_id"])


def faq_hit(spark, d):
    """Opening questions are the FAQ; every user turn asks, padded and in mixed case."""
    asked = _user_turns(spark, d).withColumn(
        "text", F.concat(F.lit("\n "), F.translate("text", "aeiou", "AEIOU"), F.lit("  "))
    )
    return C.faq_hits(asked, _faq(spark, d), "text").select(
        "conv_id", "turn", F.coalesce("faq_id", F.lit(-1)).alias("faq_id")
    )


def route_questions(spark, d):
    """All user turns; the user is the conversation, the query vector has the conversation's number.

    Vectors are searched for the questions that neither FAQ nor history answers, once for both figures.
    """
    vectors = _vectors(spark, d).withColumn("mode", _mode("label"))
    asked = _asked(spark, d).withColumn("mode", _mode("label"))

    def search(open_: DataFrame) -> DataFrame:
        return best_and_cached(vectors, asked.join(open_, "qid", "left_semi"), ["text", "voice"], floor=FLOOR + 0.05, skip_self=True)

    turns = _user_turns(spark, d).select(
        "conv_id", "turn", F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), F.col("text").alias("question"),
        F.lit(1).alias("quota"), F.col("conv_id").alias("qid"),
    )
    stored = _user_turns(spark, d).where(F.col("turn") >= 6).select(
        F.col("conv_id").alias("user_id"), "text", "turn", F.col("turn").alias("answer_id")
    )
    history = C.history_index(stored, "user_id", "text", "turn", ["answer_id"])
    routed = route(turns, _faq(spark, d), history, floor=FLOOR - 0.02, search=search)
    return routed.select("conv_id", "turn", "route", "charged")


def pending_work(spark, d):
    return A.pending(_docs(spark, d).select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def resume_offset(spark, d):
    chunks = table(spark, d, "conversations").select("conv_id", "turn")
    progress = table(spark, d, "labels").select(
        F.col("doc_id").alias("conv_id"), (F.col("quality") * 2).alias("done"), (F.col("toxic") == 1).alias("complete")
    )
    return A.resume(chunks, progress, "conv_id", "turn")


def batch_plan(spark, d):
    return A.batch_plan(table(spark, d, "conversations"), "conv_id", "turn", size=2, every=2)


def corpus_stats(spark, d):
    docs = _docs(spark, d).select("source", X.clean_text(F.col("text"), CT.MARKERS).alias("text"))
    return S.corpus_stats(docs, "source", "text").withColumn("cost_usd", F.round("cost_usd", 6))


def corpus_totals(spark, d):
    docs = _docs(spark, d).select("source", X.clean_text(F.col("text"), CT.MARKERS).alias("text"))
    return S.corpus_totals(S.corpus_stats(docs, "source", "text"))


def ordered_concat(spark, d):
    return O.ordered_parts(_docs(spark, d), "source", "doc_id", "text", part_chars=20_000)


def chapter_concat(spark, d):
    """Each source is a book of 18 chapters; texts in order of chapter and id, a head before each chapter."""
    verses = _docs(spark, d).select(
        "source", (F.col("doc_id") % 18 + 1).alias("chapter"), ((F.col("doc_id") % 18 + 1) * 1_000_000_000_000 + F.col("doc_id")).alias("place"), "text"
    )
    headed = O.with_chapter_heads(verses, ["source"], "chapter", "place", "text")
    parts = O.ordered_parts(headed, "source", "place", "text", part_chars=20_000)
    return parts.select("source", "part", "n_texts", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def running_budget(spark, d):
    log = _docs(spark, d).select(
        "doc_id", "text", F.when(F.col("lang") == "de", F.col("n_chars") / 1000.0).alias("actual")
    )
    return S.running_budget(log, "doc_id", "text", "actual")


def answer_cache_stream(spark, d):
    """Events as a stream of uses of cached answers, one file a batch; the version the pointer names."""
    root = f"{checkpoint_folder(spark)}/cache-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    uses = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")  # a pattern may name a file or a folder
    uses = uses.select(F.col("user_id").alias("id"), F.col("ts").alias("last_used_at"))
    maintain_answer_cache(uses, f"{root}/versions", f"{root}/offsets", n=50)
    return current_cache(spark, f"{root}/versions")


def prefix_until_target(spark, d):
    clips = _docs(spark, d).select("doc_id", (F.col("n_chars") * 60).alias("duration_ms"))
    return S.prefix_until(clips, "doc_id", "duration_ms", 3 * 3_600_000)


def trim_plan(spark, d):
    plan = S.trim_plan(F.col("n_chars") * 60)
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in plan.items()])


def year_histogram(spark, d):
    letters = CT._letters(spark, d).select(H.year_of(H.date_text(F.col("text"))).alias("year"), "text")
    return S.year_histogram(letters, "year", "text")


def shard_merge(spark, d):
    return O.shard_merge(_vectors(spark, d).select("vec_id", "label"), "label", "vec_id")


def dense_spine_counts(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("chapter"), "l_quantity")
    return A.spine_counts(items, "chapter", 1, 18, "l_quantity")


def _users(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_nationkey") % 6).alias("text_quota"), (F.col("c_nationkey") % 3).alias("voice_quota"), "c_nationkey",
    )


def user_upsert(spark, d):
    source = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1450).alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    defaults = {"segment": F.lit("NEW"), "text_quota": F.lit(A.TEXT_QUOTA), "voice_quota": F.lit(A.VOICE_QUOTA)}
    merged = A.upsert(_users(spark, d).drop("c_nationkey"), source, "c_custkey", ["name", "balance"], defaults)
    return merged.withColumns(
        {"text_quota": F.col("text_quota").cast("long"), "voice_quota": F.col("voice_quota").cast("long")}
    )


def quota_reset(spark, d):
    region = table(spark, d, "region").where(F.col("r_name") == "ASIA")
    listed = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    done = A.reset_quota(_users(spark, d), listed.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")
    return done.select(
        "c_custkey", F.col("text_quota").cast("long").alias("text_quota"),
        F.col("voice_quota").cast("long").alias("voice_quota"), "updated",
    )


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", ST.epoch_micros("ts")).withColumn(
        "failed", F.col("event_type") == "error"
    )


def quota_ledger(spark, d):
    """Values above 10 are voice requests, errors are refunded, users without an account have no quota."""
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    mode = F.when(F.col("value") > 10, "voice").otherwise("text")
    base = F.when(mode == "text", A.TEXT_QUOTA).otherwise(A.VOICE_QUOTA)
    requests = _events(spark, d).join(accounts, "user_id", "left").select(
        "event_id", "user_id", mode.alias("mode"), "at", (~F.col("failed")).alias("kept"),
        F.when(F.col("known"), base).otherwise(0).alias("quota"),
    )
    ledger = ST.quota_ledger(requests, by=["user_id", "mode"], order=["at", "event_id"], quota="quota", kept="kept")
    return ledger.select("event_id", "mode", "decision", "remaining")


def rate_limit(spark, d):
    return ST.keyed_decisions(_events(spark, d), ST.Limiter(*LIMIT), key="user_id", at="at", id_col="event_id")


def circuit_breaker(spark, d):
    return ST.keyed_decisions(
        _events(spark, d), ST.Breaker(*BREAK), key="user_id", at="at", id_col="event_id", flag="failed"
    )


def latest_status(spark, d):
    return C.latest(_events(spark, d), ["user_id"], F.struct("at", "event_id"), ["event_id", "event_type"])


def lru_keep_n(spark, d):
    entries = C.latest(_events(spark, d), ["user_id"], F.struct("at", "event_id"), ["event_id", "at"])
    return C.keep_most_recent(entries, "at", "event_id", 100).select("user_id", "event_id")


def outcome_rates(spark, d):
    return S.outcome_rates(
        table(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase", "error", "signup"], ["click", "purchase"]
    )


QUERIES = {
    f.__name__: f
    for f in (
        embed_cache_hits, embed_cache_misses, embed_cache_stats, embed_chunks, exact_history_hit, history_page, faq_hit,
        route_questions, pending_work, resume_offset, batch_plan, corpus_stats, corpus_totals, ordered_concat,
        chapter_concat, running_budget, answer_cache_stream, prefix_until_target, trim_plan, year_histogram, shard_merge, dense_spine_counts, user_upsert,
        quota_reset, quota_ledger, rate_limit, circuit_breaker, latest_status, lru_keep_n, outcome_rates,
    )
}



def _py_round(x: str, digits: int) -> str:
    """Round to the decimal nearest to the exact binary value, from the exact remainder of the product."""
    m, high = f"(abs({x}) * 1e{digits})", f"(134217729e0 * abs({x}) - (134217729e0 * abs({x}) - abs({x})))"
    rest = f"(({high} * 1e{digits} - {m}) + (abs({x}) - {high}) * 1e{digits} + ({m} - floor({m}) - 0.5e0))"
    up = f"CASE WHEN {rest} > 0 OR ({rest} = 0 AND floor({m}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(sign({x}) * (floor({m}) + {up}) / 1e{digits})"


_WS = CT.WS
_KEY = f"md5(lower(trim(text, {_WS})))"
_CACHED = f"""cached AS (SELECT {_KEY} AS h, max(doc_id) AS cached_id FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOOKS = f"""books AS (SELECT source, count(*) AS n_files, (sum(length(t)) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM (
  SELECT source, {CT._CLEAN} AS t FROM documents) WHERE t <> '' GROUP BY source), stats AS (
  SELECT *, n_chars // 4 AS tokens, (n_chars // 4) / 1000000.0::DOUBLE * 0.12::DOUBLE AS cost FROM books)"""
_USERS = """users AS (SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
  (c_nationkey % 6)::BIGINT AS text_quota, (c_nationkey % 3)::BIGINT AS voice_quota, c_nationkey FROM customer)"""
_ORDERED = "e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"

_EMBED_CHUNKS = f"""WITH ch AS (SELECT doc_id, chunk_id, text FROM ({CT.SQL['chunk_documents']})), w AS (
  SELECT doc_id, chunk_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM ch),
  n AS (SELECT doc_id, chunk_id, ('0x' || substr(md5(word), 1, 8))::UBIGINT % 64 AS slot, count(*)::FLOAT AS n FROM w GROUP BY ALL),
  v AS (SELECT doc_id, chunk_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_id))::FLOAT AS x FROM n)
SELECT ch.doc_id, ch.chunk_id, 64::BIGINT AS dim, coalesce(round(sqrt(sum(x::DOUBLE * x::DOUBLE)), 4), 0) AS norm,
  coalesce(round(sum(x::DOUBLE * (slot + 1)), 5), 0) AS weighted
FROM ch LEFT JOIN v ON v.doc_id = ch.doc_id AND v.chunk_id = ch.chunk_id GROUP BY ALL"""

SQL = {
    "embed_chunks": _EMBED_CHUNKS,
    "embed_cache_hits": f"""WITH {_CACHED} SELECT doc_id, h AS query_hash, cached_id FROM documents JOIN cached ON {_KEY} = h""",
    "embed_cache_misses": f"""WITH {_CACHED} SELECT doc_id, {_KEY} AS query_hash FROM documents
WHERE {_KEY} NOT IN (SELECT h FROM cached)""",
    "embed_cache_stats": f"""WITH k AS (SELECT count(*) AS n FROM documents GROUP BY {_KEY}), t AS (
  SELECT count(*) AS u, sum(n)::BIGINT AS t FROM k)
SELECT u AS unique_queries, t AS accesses, {_py_round('(t / u)', 2)} AS avg_accesses, {_py_round('((t - u) / t * 100)', 1)} AS hit_rate,
  t - u AS calls_saved, {_py_round('((t - u) * 0.0012::DOUBLE)', 4)} AS cost_saved FROM t""",
    "exact_history_hit": f"""WITH h AS (SELECT source, translate(trim(text), '{_UPPER}', '{_LOWER}') AS k,
  max(doc_id) AS answer_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(answer_id, -1) AS answer_id FROM documents d
LEFT JOIN h ON d.source = h.source AND lower(trim(d.text, {_WS})) = k""",
    "history_page": """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders)
SELECT o_custkey, position, o_orderkey, o_totalprice, total FROM r WHERE position BETWEEN 3 AND 5""",
    "faq_hit": f"""WITH f AS (SELECT lower(trim(text, {_WS})) AS k, max(conv_id) AS faq_id FROM conversations
  WHERE role = 'user' AND turn = 0 GROUP BY 1)
SELECT conv_id, turn, coalesce(faq_id, -1) AS faq_id FROM conversations
LEFT JOIN f ON lower(trim(text, {_WS})) = k WHERE role = 'user'""",
    "route_questions": f"""WITH {ALL_PAIRS}, best AS (SELECT qid, max(sim) AS best FROM pairs GROUP BY qid), cached AS (
  SELECT DISTINCT qid FROM pairs WHERE (q_label < 5) = (c_label < 5) AND sim >= {FLOOR + 0.05}), f AS (
  SELECT DISTINCT lower(trim(text, {_WS})) AS k FROM conversations WHERE role = 'user' AND turn = 0), h AS (
  SELECT DISTINCT conv_id AS u, translate(trim(text), '{_UPPER}', '{_LOWER}') AS k FROM conversations
  WHERE role = 'user' AND turn >= 6), r AS (
  SELECT conv_id, turn, CASE WHEN lower(trim(text, {_WS})) IN (SELECT k FROM f) THEN 'faq'
    WHEN EXISTS (SELECT 1 FROM h WHERE u = conv_id AND k = lower(trim(text, {_WS}))) THEN 'exact'
    WHEN conv_id IN (SELECT qid FROM cached) THEN 'semantic'
    WHEN coalesce(best, -1) < {FLOOR - 0.02} THEN 'no_match' ELSE 'answer' END AS route
  FROM conversations LEFT JOIN best ON conv_id = qid WHERE role = 'user'), l AS (
  SELECT *, route IN ('semantic', 'answer') AS kept, coalesce(count(*) FILTER (route IN ('semantic', 'answer')) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r)
SELECT conv_id, turn, CASE WHEN route <> 'faq' AND spent >= 1 THEN 'refused' ELSE route END AS route,
  kept AND spent < 1 AS charged FROM l""",
    "pending_work": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "resume_offset": """SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id
WHERE coalesce(l.toxic, 0) = 0 AND c.turn >= coalesce(l.quality * 2, 0)""",
    "batch_plan": """WITH b AS (SELECT conv_id, turn // 2 AS batch, count(*) AS n_chunks FROM conversations GROUP BY ALL)
SELECT conv_id, batch, n_chunks, (batch + 1) % 2 = 0 OR batch = max(batch) OVER (PARTITION BY conv_id) AS checkpoint FROM b""",
    "corpus_stats": f"WITH {_BOOKS} SELECT source, n_files, n_chars, tokens, round(cost, 6) AS cost_usd FROM stats",
    "corpus_totals": f"""WITH {_BOOKS} SELECT count(*) AS n_books, sum(n_files)::BIGINT AS n_files, sum(n_chars)::BIGINT AS n_chars,
  sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost_usd FROM stats""",
    "ordered_concat": """WITH p AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY source
  ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20000 AS part FROM documents)
SELECT source, part, count(*) AS n_texts, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM p GROUP BY ALL""",
    "chapter_concat": """WITH f AS (SELECT source, doc_id % 18 + 1 AS chapter, doc_id, text FROM documents), t AS (
  SELECT source, chapter, doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source, chapter) THEN chr(10) || chr(10)
    || repeat('=', 60) || chr(10) || 'CHAPTER ' || chapter || chr(10) || repeat('=', 60) || chr(10) || chr(10) ELSE '' END || text AS t FROM f),
p AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY source ORDER BY chapter, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20000 AS part FROM t),
j AS (SELECT source, part, count(*) AS n_texts, string_agg(t, chr(10) || chr(10) ORDER BY chapter, doc_id) AS t FROM p GROUP BY ALL)
SELECT source, part, n_texts, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM j""",
    "running_budget": f"""WITH c AS (
  SELECT doc_id, {_py_round('((length(text) // 4) / 1000000.0::DOUBLE * 0.12::DOUBLE)', 4)} AS est,
  CASE WHEN lang = 'de' AND n_chars <> 0 THEN round(n_chars / 1000.0::DOUBLE, 4) END AS act FROM documents), r AS (
  SELECT doc_id, est, coalesce(act, est) AS cost, round(sum(coalesce(act, est)) OVER (ORDER BY doc_id), 4) AS total FROM c)
SELECT doc_id, est AS estimated_usd, cost AS cost_usd, total AS total_usd, round(10.0 - total, 4) AS remaining_usd,
  10.0 - total < 1.0 AS low FROM r""",
    "answer_cache_stream": """SELECT user_id AS id, max(ts) AS last_used_at FROM events GROUP BY user_id
ORDER BY last_used_at DESC, id DESC LIMIT 50""",
    "prefix_until_target": """WITH o AS (SELECT doc_id, n_chars * 60 AS duration_ms, coalesce(sum(n_chars * 60 + 500) OVER (
  ORDER BY substr(md5('42' || doc_id), 1, 13), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
  AS before_ms FROM documents) SELECT doc_id, duration_ms, before_ms FROM o WHERE before_ms < 10800000""",
    "trim_plan": f"""WITH p AS (SELECT doc_id, n_chars * 60 AS d, CASE WHEN n_chars * 60 < 720000 THEN 0
  WHEN n_chars * 60 < 900000 THEN 180000 ELSE 300000 END::BIGINT AS side FROM documents)
SELECT doc_id, CASE WHEN side = 0 THEN 'skipped' ELSE 'trimmed' END AS action, side AS side_ms,
  {_py_round('(d / 60000.0::DOUBLE)', 1)} AS before_min, {_py_round('((d - 2 * side) / 60000.0::DOUBLE)', 1)} AS after_min,
  {_py_round('(2 * side / 60000.0::DOUBLE)', 1)} AS removed_min FROM p""",
    "year_histogram": f"""WITH t AS (SELECT CASE WHEN o_orderstatus IN ('O', 'F') THEN strftime(o_orderdate, '%Y') END AS year,
  {CT._LETTER} AS text FROM orders), g AS (SELECT year, count(*) AS n, sum(length(text))::BIGINT AS n_bytes FROM t
  WHERE year IS NOT NULL GROUP BY year)
SELECT year, n, n_bytes, round(n_bytes * 0.25::DOUBLE / 1000000 * 0.18::DOUBLE, 6) AS cost_usd FROM g ORDER BY n DESC, year LIMIT 5""",
    "shard_merge": "SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS chunk_id FROM embeddings",
    "dense_spine_counts": """WITH g AS (SELECT l_linenumber AS c, count(*) AS n, sum(l_quantity)::BIGINT AS s FROM lineitem GROUP BY 1),
d AS (SELECT chapter, coalesce(n, 0) AS n_items, coalesce(s, 0) AS size FROM range(1, 19) r(chapter) LEFT JOIN g ON c = chapter)
SELECT chapter, n_items, size, count(*) FILTER (n_items > 0) OVER () AS n_filled,
  round(count(*) FILTER (n_items > 0) OVER () * 100.0::DOUBLE / 18, 2) AS complete_pct FROM d""",
    "user_upsert": f"""WITH {_USERS}, s AS (SELECT s_suppkey + 1450 AS k, s_name, s_acctbal FROM supplier)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN s_name ELSE name END AS name,
  CASE WHEN k IS NOT NULL THEN s_acctbal ELSE balance END AS balance,
  CASE WHEN c_custkey IS NULL THEN 'NEW' ELSE segment END AS segment,
  CASE WHEN c_custkey IS NULL THEN 5 ELSE text_quota END AS text_quota,
  CASE WHEN c_custkey IS NULL THEN 2 ELSE voice_quota END AS voice_quota FROM users FULL JOIN s ON c_custkey = k""",
    "quota_reset": f"""WITH {_USERS}, n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT * FROM n) THEN 5 ELSE text_quota END AS text_quota,
  CASE WHEN c_nationkey IN (SELECT * FROM n) THEN 2 ELSE voice_quota END AS voice_quota,
  c_nationkey IN (SELECT * FROM n) AS updated FROM users""",
    "quota_ledger": """WITH r AS (SELECT event_id, ts, user_id, CASE WHEN value > 10 THEN 'voice' ELSE 'text' END AS mode,
  event_type <> 'error' AS kept, CASE WHEN c_custkey IS NULL THEN 0 WHEN value > 10 THEN 2 ELSE 5 END AS quota
  FROM events LEFT JOIN customer ON user_id = c_custkey), l AS (
  SELECT *, greatest(quota - count(*) FILTER (kept) OVER (PARTITION BY user_id, mode ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bal FROM r)
SELECT event_id, mode, CASE WHEN bal = 0 THEN 'refused' WHEN kept THEN 'charged' ELSE 'refunded' END AS decision,
  CASE WHEN bal > 0 AND kept THEN bal - 1 ELSE bal END AS remaining FROM l""",
    "rate_limit": f"""WITH RECURSIVE {_ORDERED}, s(user_id, rn, event_id, log, decision) AS (
  SELECT user_id, rn, event_id, [us], 'accepted' FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN len(f) >= {LIMIT[0]} THEN f ELSE list_append(f, us) END,
    CASE WHEN len(f) >= {LIMIT[0]} THEN 'rejected' ELSE 'accepted' END FROM (
    SELECT e.user_id, e.rn, e.event_id, e.us, list_filter(s.log, lambda t: e.us - t <= {LIMIT[1]}000000) AS f
    FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT event_id, decision FROM s""",
    "circuit_breaker": f"""WITH RECURSIVE {_ORDERED}, s(user_id, rn, event_id, opened, recent, decision) AS (
  SELECT user_id, 0::BIGINT, -1::BIGINT, -1::BIGINT, []::BIGINT[], '' FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id,
    CASE WHEN o >= 0 THEN o WHEN fail AND len(f) >= {BREAK[0]} THEN us ELSE -1 END,
    CASE WHEN o >= 0 THEN r WHEN fail THEN f ELSE [] END,
    CASE WHEN o >= 0 THEN 'blocked' ELSE pre || CASE WHEN NOT fail THEN 'success' WHEN len(f) >= {BREAK[0]} THEN 'opened'
      ELSE 'failure' END END FROM (
    SELECT *, list_filter(list_append(r, us), lambda t: t >= us - {BREAK[1]}000000) AS f FROM (
      SELECT e.user_id, e.rn, e.event_id, e.us, e.event_type = 'error' AS fail,
        CASE WHEN s.opened >= 0 AND e.us - s.opened >= {BREAK[2]}000000 THEN -1 ELSE s.opened END AS o,
        CASE WHEN s.opened >= 0 AND e.us - s.opened >= {BREAK[2]}000000 THEN []::BIGINT[] ELSE s.recent END AS r,
        CASE WHEN s.opened >= 0 AND e.us - s.opened >= {BREAK[2]}000000 THEN 'closed_' ELSE '' END AS pre
      FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)))
SELECT event_id, decision FROM s WHERE rn > 0""",
    "latest_status": """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""",
    "lru_keep_n": """WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id)
SELECT user_id, event_id FROM l ORDER BY ts DESC, event_id DESC LIMIT 100""",
    "outcome_rates": f"""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view,
  count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') AS n_signup,
  count(*) FILTER (event_type IN ('click', 'purchase')) * 100.0::DOUBLE / count(*) AS rate FROM events GROUP BY user_id)
SELECT user_id, n_view, n_click, n_purchase, n_error, n_signup, {_py_round('rate', 1)} AS success_pct FROM r""",
}
