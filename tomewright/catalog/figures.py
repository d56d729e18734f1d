"""Registered queries over small operators: gates, selections, recent rows, accumulated sets, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.catalog.corpus_text import FOLD, RESIDUE
from tomewright.catalog.tables import table
from tomewright.functions import strings as S
from tomewright.functions import text as X
from tomewright.operators import accounts as A
from tomewright.operators import caches as C
from tomewright.operators import stats as ST


def quota_gate(spark, d):
    """Customers are the accounts; events ask for text (views, clicks) or voice (all others)."""
    users = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 6).cast("int").alias("text_quota"),
        (F.col("c_nationkey") % 3).cast("int").alias("voice_quota"),
    )
    asked = table(spark, d, "events").select(
        "event_id", "user_id", F.when(F.col("event_type").isin("view", "click"), "text").otherwise("voice").alias("mode")
    )
    gated = A.quota_gate(asked, users, "user_id", "mode")
    return gated.select("event_id", "mode", F.col("remaining").cast("long").alias("remaining"), F.col("used").cast("long").alias("used"))


def selection_summary(spark, d):
    """Documents as clips of 60 ms a character."""
    clips = table(spark, d, "documents").select((F.col("n_chars") * 60).alias("duration_ms"))
    return ST.selection_summary(clips, "duration_ms").withColumn("hours", F.round("hours", 6))


def recent_entries(spark, d):
    return ST.recent_entries(table(spark, d, "events").select("event_id", "event_type"), "event_id")


def email_words(spark, d):
    """Words of the documents that are whole e-mail addresses."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \n]")).alias("word"))
    return words.where(S.is_email(F.col("word"))).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def fifo_keep_n(spark, d):
    """The 500 jobs begun last."""
    return C.keep_newest(table(spark, d, "events").select("event_id", "user_id"), "event_id", 500)


def accumulate_urls(spark, d):
    """Page addresses known after three rounds of fetching, each round a third of the pages."""
    pages = table(spark, d, "pages").select("url", F.col("page_id").alias("round_row"))
    known = pages.where("false").select("url")
    for k in range(3):
        known = A.accumulate(known, pages.where(F.col("round_row") % 3 == k).select("url"), "url")
    return known


def url_counts(spark, d):
    """Rows, different addresses and bytes of the page store."""
    return table(spark, d, "pages").agg(
        F.count("*").alias("n_rows"), F.count_distinct("url").alias("n_urls"), F.sum(F.octet_length("html")).alias("n_bytes")
    )


def missed_terms(spark, d):
    """Different words that still hold a letter transliteration should have replaced, over all documents."""
    rows = X.residual_rows(table(spark, d, "documents"), X.transliterate(F.col("text"), FOLD), ["doc_id"], RESIDUE)
    return X.missed_terms(rows)


def year_report(spark, d):
    letters = table(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("year"))
    return ST.year_report(letters, "year")


def verse_counts(spark, d):
    """Items of each chapter and of all chapters."""
    return ST.counts_and_total(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("chapter")), "chapter")


QUERIES = {
    f.__name__: f
    for f in (
        quota_gate, selection_summary, recent_entries, email_words, fifo_keep_n, accumulate_urls, url_counts,
        missed_terms, year_report, verse_counts,
    )
}

SQL = {
    "quota_gate": """WITH a AS (SELECT event_id, user_id, event_type IN ('view', 'click') AS t FROM events)
SELECT event_id, CASE WHEN t THEN 'text' ELSE 'voice' END AS mode,
  coalesce(CASE WHEN t THEN c_custkey % 6 ELSE c_nationkey % 3 END, 0)::BIGINT AS remaining,
  (CASE WHEN t THEN 5 ELSE 2 END - coalesce(CASE WHEN t THEN c_custkey % 6 ELSE c_nationkey % 3 END, 0))::BIGINT AS used
FROM a LEFT JOIN customer ON c_custkey = user_id""",
    "selection_summary": """WITH h AS (SELECT count(*) AS n, (sum(n_chars * 60) + 500 * (count(*) - 1)) / 3600000.0::DOUBLE AS h FROM documents)
SELECT n AS n_clips, round(h, 6) AS hours, CASE WHEN h < 2 THEN 'short' WHEN h > 3.5 THEN 'long' ELSE 'ok' END AS verdict FROM h""",
    "recent_entries": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5",
    "email_words": """SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents)
WHERE regexp_full_match(word, '[[:alnum:]._%+-]+@[[:alnum:].-]+[.][[:alpha:]][[:alpha:]]+') GROUP BY ALL""",
    "fifo_keep_n": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500",
    "accumulate_urls": "SELECT DISTINCT url FROM pages",
    "url_counts": "SELECT count(*) AS n_rows, count(DISTINCT url) AS n_urls, sum(strlen(html))::BIGINT AS n_bytes FROM pages",
    "missed_terms": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({{text}}, '\\S+')) AS word FROM documents)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_rows FROM w WHERE regexp_matches(word, '[{RESIDUE}]') GROUP BY word""",
    "year_report": """SELECT count(*) AS n_letters, count(DISTINCT year(o_orderdate)) AS n_years,
  min(year(o_orderdate))::VARCHAR AS first_year, max(year(o_orderdate))::VARCHAR AS last_year FROM orders""",
    "verse_counts": """SELECT l_linenumber::VARCHAR AS chapter, count(*) AS n FROM lineitem GROUP BY l_linenumber
UNION ALL SELECT 'all', count(*) FROM lineitem""",
}
_folded = "text"
for _from, _to in FOLD:
    _folded = f"replace({_folded}, '{_from}', '{_to}')"
SQL["missed_terms"] = SQL["missed_terms"].replace("{text}", _folded)
