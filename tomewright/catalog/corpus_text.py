"""Registered text queries over documents, conversations, pages and derived reference strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.catalog.tables import spread, table
from tomewright.functions import html as H
from tomewright.functions import strings as S
from tomewright.functions import text as X
from tomewright.operators import blocks as B
from tomewright.operators import chunk as K

MARKERS = ["License", "license"]
REPEATED = "The and attion to thanedble the, anea. Eriner thanea."
FOLD = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("é", "e"), ("è", "e"), ("ñ", "n"), ("ç", "c")]
TERMS = {"tion": "shun", "ation": "ayshun", "keit": "kite", "the": "thuh", "eau": "oh", "sch": "sh", "mente": "mentay"}
RESIDUE = "äöüßéèñçêóíÄÖÜÉÈÑÇÊÓÍ"
VOCAB = X.Vocabulary(
    exclusive=["ver", "ment", "ing", "sch", "aux", "ou", "que", "ti", "rr", "ue"],
    common=["re", "on", "en", "er", "es", "th", "nd", "ge", "be", "mi"],
    function_words=["the", "of", "and", "le", "de", "la", "et", "der", "die", "und", "in", "is", "que", "el", "y"],
    endings="(?:ment|keit|tion|ing|ción)$",
    letters="[ñß]",
    mantra="(?i)and the.*the of.*of the",
    reference="^(The |Die |De |El )",
)
HEADER = "\\S+\\."
NAMES = {"bg": "First Work", "sb": "Second Work", "cc": "Third Work", "letters": "Letters"}
LANGS = {"de": "German", "en": "English", "fr": "French"}


def _docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def _turns(spark, d):
    return spread(table(spark, d, "conversations"), "conv_id", "turn")


def _pages(spark, d):
    return spread(table(spark, d, "pages"), "page_id")


def clean_lines(spark, d):
    text = X.clean_text(F.col("text"), MARKERS)
    return _docs(spark, d).select("doc_id", S.once(text).alias("text")).where(F.col("text") != "")


def keep_first_prefixed_line(spark, d):
    return _docs(spark, d).select("doc_id", X.keep_first_prefixed_line(F.col("text"), [REPEATED]).alias("text"))


def section_slice(spark, d):
    return _docs(spark, d).select("doc_id", X.section_slice(F.col("text"), " the ", " and ").alias("text"))


def token_stats(spark, d):
    n = S.word_count(F.col("text"))
    return _docs(spark, d).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        n.alias("n_words"),
        S.token_estimate(F.col("text")).alias("tokens"),
        F.round(S.spoken_minutes(n), 4).alias("minutes"),
        (n < S.MIN_SPOKEN_WORDS).alias("too_short"),
    )


def truncate_inputs(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id",
        F.md5(S.head_words(t, 3000).cast("binary")).alias("words_3000"),
        F.md5(S.head_chars(t, 6000).cast("binary")).alias("chars_6000"),
        F.md5(S.head_chars(t, 5000).cast("binary")).alias("chars_5000"),
        F.md5(S.head_chars(t, 800).cast("binary")).alias("chars_800"),
    )


def query_validation(spark, d):
    k = (F.col("n_chars") % 60).cast("int")
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id",
        S.reject_reason(t, k, max_chars=1000, max_k=50, strip_first=False).alias("search"),
        S.reject_reason(t, k, max_chars=500, max_k=20, strip_first=True).alias("answer"),
    )


def conv_segments(spark, d):
    """Documents as month files; a line of one word and a period is the id line."""
    files = _docs(spark, d).select("doc_id", F.lit(1975).alias("year"), F.col("lang").alias("month"), "text")
    return X.conversation_blocks(files, header=HEADER, keep=["doc_id"]).drop("year", "month")


def chunk_documents(spark, d):
    return K.chunk_documents(_docs(spark, d).select("doc_id", "text"))


def chunk_conversations(spark, d):
    turns = _turns(spark, d).select(
        "conv_id", "turn", F.lit(1975).alias("year"), F.col("role").alias("month"), "text"
    )
    return K.chunk_conversations(turns, max_words=60).drop("year", "month")


def sentence_explode(spark, d):
    return X.sentence_rows(_turns(spark, d), "text", ["conv_id", "turn"], paragraph="\n")


def sentence_groups(spark, d):
    turns = _turns(spark, d)
    groups = F.posexplode(X.sentence_groups(F.col("text"))).alias("grp", "paragraph")
    return turns.select("conv_id", "turn", groups).withColumn("grp", F.col("grp").cast("long"))


def dict_replace(spark, d):
    return _docs(spark, d).select("doc_id", X.replace_terms(F.col("text"), TERMS).alias("text"))


def translit_fold(spark, d):
    return _docs(spark, d).select("doc_id", X.transliterate(F.col("text"), FOLD).alias("text"))


def residual_terms(spark, d):
    return X.residual_rows(_docs(spark, d), X.transliterate(F.col("text"), FOLD), ["doc_id"], RESIDUE)


def _references(spark, d):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    ref = F.concat(
        F.lit("see BG "), n, F.lit("."), s, F.lit(", SB "), n, F.lit("."), s, F.lit(".0"), n, F.lit(" and Geeta, "),
        s, F.lit("."), n, F.lit("; CC "), s, F.lit(" x"),
    )
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return spread(rows, "l_orderkey").select("l_orderkey", "l_linenumber", ref.alias("ref"))


def verse_ref_spoken(spark, d):
    return _references(spark, d).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
        X.spoken_references(F.col("ref")).alias("spoken"),
    )


def markdown_clean(spark, d):
    return _docs(spark, d).select("doc_id", X.voice_clean(F.col("text")).alias("text"))


def voice_preprocess(spark, d):
    tail = F.concat(F.lit(" (see BG "), F.col("n_chars") % 90, F.lit("."), F.col("doc_id") % 90, F.lit(")"))
    text = F.concat("text", tail)
    return _docs(spark, d).select("doc_id", X.preprocess_for_voice(text, TERMS, FOLD).alias("text"))


def share_format(spark, d):
    return _docs(spark, d).select("doc_id", X.share_text(F.col("source"), F.col("text"), "- shared").alias("text"))


def line_class(spark, d):
    facts = F.posexplode(X.line_facts(F.split("text", "\n"), VOCAB)).alias("line_no", "f")
    return _docs(spark, d).select("doc_id", facts).select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("f.n_words").cast("long").alias("n_words"),
        F.col("f.n_exclusive").cast("long").alias("n_exclusive"),
        F.col("f.n_common").cast("long").alias("n_common"),
        F.col("f.n_english").cast("long").alias("n_english"),
        X.is_verse(F.col("f")).alias("verse"),
    )


def block_parse(spark, d):
    return B.line_rows(_docs(spark, d), "text", ["doc_id"], VOCAB)


def verse_cards(spark, d):
    rows = B.card_rows(_docs(spark, d), "text", ["doc_id"], VOCAB)
    return rows.withColumn("items", F.array_join("items", "\n"))


def term_runs(spark, d):
    return X.term_runs(_docs(spark, d), "text", ["doc_id"], VOCAB)


def html_links(spark, d):
    return H.link_rows(_pages(spark, d), ["page_id"])


def html_title(spark, d):
    return _pages(spark, d).select("page_id", H.page_title(F.col("html")).alias("title"))


def html_text(spark, d):
    return _pages(spark, d).select("page_id", H.content_text(F.col("html")).alias("content"))


def url_slug(spark, d):
    name = H.slug_title(F.col("url"), "/([^/?#]+)/?(?:[?#].*)?$")
    return _pages(spark, d).select("page_id", name.alias("recipient"))


def first_seen_links(spark, d):
    return H.first_seen(H.link_rows(_pages(spark, d), ["page_id"]))


def _letters(spark, d):
    """Orders as letters that state their date in one of three ways."""
    day = F.col("o_orderdate")
    dated = (
        F.when(F.col("o_orderstatus") == "O", F.date_format(day, "MMMM d, yyyy"))
        .when(F.col("o_orderstatus") == "F", F.date_format(day, "d MMMM yyyy"))
        .otherwise("undated")
    )
    text = F.concat(F.lit("Date: "), dated, F.lit("\nPlace: New Town\nPriority "), F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return spread(rows, "o_orderkey").select("o_orderkey", text.alias("text"))


def date_extract(spark, d):
    date = H.date_text(F.col("text"))
    return _letters(spark, d).select(
        "o_orderkey", F.coalesce(date, F.lit("none")).alias("date"), H.year_of(date).alias("year"),
        H.place_text(F.col("text")).alias("location"),
    )


def title_facets(spark, d):
    place = F.when(F.col("o_orderstatus") == "O", "London").when(F.col("o_orderstatus") == "F", "new york").otherwise("Rome")
    unit = F.when(F.col("o_orderpriority").startswith("1"), "KB").when(F.col("o_orderpriority").startswith("2"), "GB").otherwise("MB")
    title = F.concat(
        F.lit("SP BG "), F.col("o_custkey"), F.lit("-01 "), place, F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" "), F.format_string("%d.25", F.floor("o_totalprice").cast("long")), F.lit(" "), unit,
    )
    f = H.title_facets(title)
    return spread(table(spark, d, "orders"), "o_orderkey").select(
        "o_orderkey", f["date"].alias("date"), F.coalesce(f["location"], F.lit("none")).alias("location"),
        f["verse"].alias("verse"), F.round(f["size_mb"], 4).alias("size_mb"),
    )


def citation_label(spark, d):
    flag = F.col("l_returnflag")
    code = F.when(flag == "A", "bg").when(flag == "N", "SB").otherwise("cc")
    chunk = F.concat_ws("_", F.lower(code), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    rows = spread(items, "l_orderkey").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), code.alias("code"), chunk.alias("chunk")
    )
    names = spark.createDataFrame(list(NAMES.items()), "key string, name string")
    named = rows.join(F.broadcast(names), F.lower("code") == F.col("key"), "left")
    label = X.citation_label(F.col("code"), F.col("chunk"), F.coalesce("name", "code"))
    return named.select("l_orderkey", "l_linenumber", "chunk", label.alias("label"))


def dim_lookup(spark, d):
    names = spark.createDataFrame(list(LANGS.items()), "key string, name string")
    docs = _docs(spark, d).select("doc_id", "lang")
    return docs.join(F.broadcast(names), F.lower("lang") == F.col("key"), "left").select(
        "doc_id", "lang", F.coalesce("name", "lang").alias("name")
    )


def keyword_score(spark, d):
    score = X.keyword_score("tion ", S.words(F.col("text")), F.col("text"), F.array("source"))
    scored = _docs(spark, d).select("doc_id", S.once(score).alias("score"))
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, keep_first_prefixed_line, section_slice, token_stats, truncate_inputs, query_validation,
        conv_segments, chunk_documents, chunk_conversations, sentence_explode, sentence_groups, dict_replace,
        translit_fold, residual_terms, verse_ref_spoken, markdown_clean, voice_preprocess, share_format, line_class,
        block_parse, verse_cards, term_runs, html_links, html_title, html_text, url_slug, first_seen_links,
        date_extract, title_facets, citation_label, dim_lookup, keyword_score,
    )
}


# -- SQL twins ----------------------------------------------------------------------------------------


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _nest(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {_sq(a)}, {_sq(b)})"
    return expr


def _re(expr: str, pattern: str, by: str, opts: str = "g") -> str:
    return f"regexp_replace({expr}, {_sq(pattern)}, {_sq(by)}, '{opts}')"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def _strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def _in(words) -> str:
    return "(" + ", ".join(_sq(w) for w in words) + ")"


_CLEAN = _strip(
    _re(f"array_to_string(list_filter(string_split(text, {NL}), lambda l: NOT contains(l, 'License') "
        f"AND NOT contains(l, 'license')), {NL})", "\n\n\n+", "\n\n")
)


def _voice_sql(expr: str) -> str:
    for pattern, by in [
        (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"#{1,6}\s+", ""), (r"`(.+?)`", r"\1"),
        (r"\[([^\]]+)\]", r"\1"), (r"\(([^)]{1,80})\)", r", \1,"),
    ]:
        expr = _re(expr, pattern, by)
    expr = _nest(expr, [("—", ", "), ("–", ", "), (";", ".")])
    return _strip(_re(_re(expr, r",\s*,", ","), r"\s{2,}", " "))


_BY_LENGTH = sorted(TERMS.items(), key=lambda kv: -len(kv[0]))
_NUMBERS = "MAP {" + ", ".join(f"{_sq(k)}: {_sq(v)}" for k, v in X.number_words().items()) + "}"


def _spoken_sql(expr: str) -> str:
    n = "@{}@"
    canto = f"canto {n.format(chr(92) + '1')}, chapter {n.format(chr(92) + '2')}, verse {n.format(chr(92) + '3')}"
    verse = f"chapter {n.format(chr(92) + '1')}, verse {n.format(chr(92) + '2')}"
    expr = f"replace({expr}, '@', chr(1))"
    expr = _re(expr, r"\bSB\s+(\d+)\.(\d+)\.(\d+)\b", "Shreemad Bhaagavatam, " + canto)
    for code, name in [
        ("BG", "Bhagavad Geeta"), ("CC", "Chaitanya Charitaamrita"), ("NOD", "Nectar of Devotion"),
        ("NOI", "Nectar of Instruction"), ("ISO", "Shree Eeshopanishad"),
    ]:
        expr = _re(expr, rf"\b{code}\s+(\d+)\.(\d+)\b", f"{name}, {verse}")
    expr = _re(expr, r"Geeta,?\s+(\d+)\.(\d+)", "Geeta, " + verse)
    expr = _re(expr, r"Bhaagavatam,?\s+(\d+)\.(\d+)\.(\d+)", "Bhaagavatam, " + canto)
    parts = (
        f"array_to_string(list_transform(string_split({expr}, '@'), lambda p, i: CASE WHEN i % 2 = 1 THEN p "
        f"ELSE coalesce({_NUMBERS}[regexp_replace(p, '^0+(.)', '\\1')], regexp_replace(p, '^0+(.)', '\\1')) END), '')"
    )
    return f"replace({parts}, chr(1), '@')"


def _tokens_sql(expr: str) -> str:
    bare = f"regexp_replace(lower({expr}), '[.,;:!?\"''()\\[\\]{{}}—–-]', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '\\s+'), lambda w: w <> '')"


_ENDS = "(?:ment|keit|tion|ing|ción)$"
_TERM = (
    f"(w IN {_in(VOCAB.exclusive)} OR w IN {_in(VOCAB.common)} OR regexp_matches(w, {_sq(_ENDS)}))"
)
_FACTS = f"""lines AS (
  SELECT doc_id, {_strip('l')} AS line, pos - 1 AS line_no FROM (
    SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (
      SELECT doc_id, string_split(SOURCE_TEXT, {NL}) AS ls FROM documents))), probes AS (
  SELECT *, CASE WHEN starts_with(line, '> ') THEN {_strip('substr(line, 3)')} ELSE line END AS probe FROM lines),
  tok AS (SELECT *, {_tokens_sql('probe')} AS t FROM probes), facts AS (
  SELECT *, len(t) AS n_words,
    len(list_filter(t, lambda w: w IN {_in(VOCAB.exclusive)} OR regexp_matches(w, {_sq(_ENDS)}))) AS n_exclusive,
    len(list_filter(t, lambda w: w IN {_in(VOCAB.common)})) AS n_common,
    len(list_filter(t, lambda w: w IN {_in(VOCAB.function_words)})) AS n_english FROM tok), judged AS (
  SELECT *, CASE WHEN length(probe) < 10 THEN false WHEN regexp_matches(probe, '[ñß]') THEN true
    WHEN n_words = 0 THEN false WHEN n_english >= 3 THEN false WHEN n_english >= 2 AND n_exclusive = 0 THEN false
    WHEN n_exclusive >= 2 THEN true
    WHEN n_exclusive >= 1 AND n_exclusive + n_common >= 3 AND n_words <= 12 THEN true
    WHEN n_english = 0 AND n_exclusive + n_common >= 3 AND n_words <= 10 THEN true
    WHEN n_english = 0 AND n_words <= 12 AND (n_exclusive + n_common) / n_words > 0.7 THEN true
    ELSE false END AS verse FROM facts)"""


def _chunk_sql(sents: str, source: str, keys: str, max_words: int, carry: int, body: str) -> str:
    on = " AND ".join(f"r.{k} = p.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    rk = ", ".join(f"r.{k}" for k in keys.split(", "))
    extra = ", role" if "role" in body else ""
    return f"""WITH RECURSIVE s AS (SELECT {keys}{extra}, {sents} AS sents FROM {source}), f AS (
  SELECT {keys}, unnest(sents) AS x, generate_subscripts(sents, 1) AS pos FROM s), c AS (
  SELECT {keys}, pos, sum(len(regexp_extract_all(x, '\\S+'))) OVER (PARTITION BY {keys} ORDER BY pos) AS cum FROM f),
  pc AS (SELECT {keys}, list(cum::BIGINT ORDER BY pos) AS cum FROM c GROUP BY ALL), p AS (
  SELECT s.*, cum FROM s JOIN pc r ON {on.replace('p.', 's.')}), step(KEYS_, no, a, trig, stop) AS (
  SELECT {pk}, 0::BIGINT, 0::BIGINT, 0::BIGINT, list_filter(range(1, len(cum)), lambda j: cum[j + 1] > {max_words})[1]
  FROM p
  UNION ALL
  SELECT {rk}, no + 1, greatest(a, stop - {carry}), stop, list_filter(range(stop + 1, len(cum)), lambda j:
    cum[j + 1] - coalesce(cum[greatest(a, stop - {carry})], 0) > {max_words})[1]
  FROM step r JOIN p ON {on} WHERE stop IS NOT NULL), q AS (
  SELECT r.*, p.sents, p.cum{', p.role' if extra else ''}, coalesce(stop, len(p.sents)) AS z FROM step r JOIN p ON {on})
SELECT {keys}, no AS chunk_id, a AS first_sentence, (z - a)::BIGINT AS n_sentences,
  (cum[z] - coalesce(cum[a], 0))::BIGINT AS n_words, {body} AS text FROM q""".replace("KEYS_", keys)


_LINKS = """links AS (SELECT page_id, url, pos - 1 AS pos, CASE WHEN starts_with(href, '/')
    THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE href END AS link, body FROM (
  SELECT page_id, url, unnest(hs) AS href, unnest(bs) AS body, generate_subscripts(hs, 1) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]+)"[^>]*>(.*?)</a>', 1) AS hs,
      regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]+)"[^>]*>(.*?)</a>', 2) AS bs FROM pages)))"""


def _unescape_sql(expr: str) -> str:
    return _nest(expr, [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"),
        ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
    ])


def _content_sql() -> str:
    expr = "html"
    for tag in ["script", "style", "nav", "header", "footer", "aside"]:
        expr = f"regexp_replace({expr}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    expr = f"regexp_replace(regexp_replace({expr}, '(?s)<!--.*?-->', chr(1), 'g'), '<[^>]+>', chr(1), 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split({expr}, chr(1)), "
        f"lambda p: trim({_unescape_sql('p')}, {WS} || chr(160))), lambda p: p <> ''), {NL})"
    )


_LETTER = """'Date: ' || CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%B %-d, %Y')
  WHEN 'F' THEN strftime(o_orderdate, '%-d %B %Y') ELSE 'undated' END || chr(10) || 'Place: New Town' || chr(10)
  || 'Priority ' || o_orderpriority"""
_DATE_1, _DATE_2 = r"\w+ \d+(?:st|nd|rd|th)?,? \d{4}", r"\d+ \w+ \d{4}"

SQL = {
    "clean_lines": f"SELECT doc_id, t AS text FROM (SELECT doc_id, {_CLEAN} AS t FROM documents) WHERE t <> ''",
    "keep_first_prefixed_line": f"""WITH l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (
  SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)), m AS (
  SELECT *, starts_with(l, {_sq(REPEATED)}) AS hit FROM l), n AS (
  SELECT *, count(*) FILTER (hit) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM m)
SELECT doc_id, string_agg(l, {NL} ORDER BY pos) AS text FROM n WHERE NOT hit OR nth = 1 GROUP BY doc_id""",
    "section_slice": """WITH p AS (SELECT doc_id, text, instr(text, ' the ') AS a, instr(text, ' and ') AS b
  FROM documents)
SELECT doc_id, CASE WHEN a = 0 THEN text WHEN b = 0 THEN substr(text, a) WHEN b <= a THEN ''
  ELSE substr(text, a, b - a) END AS text FROM p""",
    "token_stats": """WITH w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT doc_id, length(text) AS n_chars, n AS n_words, length(text) // 4 AS tokens, round(n / 120.0::DOUBLE, 4) AS minutes,
  n < 340 AS too_short FROM w""",
    "truncate_inputs": """WITH w AS (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM documents)
SELECT doc_id, md5(CASE WHEN len(ws) > 3000 THEN array_to_string(ws[1:3000], ' ') || '...' ELSE text END) AS words_3000,
  md5(substr(text, 1, 6000)) AS chars_6000, md5(substr(text, 1, 5000)) AS chars_5000,
  md5(substr(text, 1, 800)) AS chars_800 FROM w""",
    "query_validation": f"""SELECT doc_id, CASE WHEN {_strip('text')} = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long'
    WHEN n_chars % 60 NOT BETWEEN 1 AND 50 THEN 'bad_top_k' ELSE 'ok' END AS search,
  CASE WHEN {_strip('text')} = '' THEN 'empty' WHEN length({_strip('text')}) > 500 THEN 'too_long'
    WHEN n_chars % 60 NOT BETWEEN 1 AND 20 THEN 'bad_top_k' ELSE 'ok' END AS answer FROM documents""",
    "conv_segments": f"""WITH l AS (SELECT doc_id, lang, {_strip('l')} AS l, pos FROM (
  SELECT doc_id, lang, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (
    SELECT doc_id, lang, string_split(text, {NL}) AS ls FROM documents))), h AS (
  SELECT *, regexp_full_match(l, '\\S+\\.') AS head, lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2,
    lead(l, 3) OVER w AS l3, lead(l, 4) OVER w AS l4 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), b AS (
  SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM h), g AS (
  SELECT doc_id, block, any_value(l) FILTER (head) AS id, any_value('1975_' || lang || '_main') AS main,
    any_value(array_to_string(list_transform(list_filter([l1, l2, l3, l4],
      lambda t: t IS NOT NULL AND t NOT IN ('', '—', '–', '-')), lambda t: t || ' '), '')) FILTER (head) AS title,
    string_agg(l, {NL} ORDER BY pos) FILTER (NOT head AND l <> '' AND NOT starts_with(l, 'Source:')
      AND NOT starts_with(l, 'Scraped:') AND NOT starts_with(l, '===')) AS body FROM b GROUP BY doc_id, block)
SELECT doc_id, block, coalesce(id, main) AS conv_id, CASE WHEN block = max(block) OVER (PARTITION BY doc_id)
  THEN {_strip("coalesce(title, '')")} ELSE coalesce(title, '') END AS title, body FROM g QUALIFY length(body) > 100""",
    "chunk_documents": _chunk_sql(
        "string_split(text, '. ')", "documents", "doc_id", 400, 3, "array_to_string(sents[a + 1:z], '. ') || '.'"
    ),
    "chunk_conversations": _chunk_sql(
        "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda x: {_strip('x')}), lambda x: x <> '')",
        "conversations", "conv_id, turn", 60, 2,
        "'[Conversations, 1975 ' || upper(role) || ', ' || conv_id || '] ' || array_to_string(sents[a + 1:z], ' ')",
    ),
    "sentence_explode": f"""WITH p AS (SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para,
    len(ps) AS n FROM (SELECT conv_id, turn, string_split(text, {NL}) AS ps FROM conversations)), s AS (
  SELECT *, list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {_strip('x')} <> '') AS ss FROM p WHERE {_strip('p')} <> '')
SELECT conv_id, turn, para, sent, sentence, sent = m - 1 AND para < n - 1 AS para_break FROM (
  SELECT conv_id, turn, para, n, len(ss) AS m, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent FROM s)""",
    "sentence_groups": f"""WITH s AS (SELECT conv_id, turn, CASE WHEN len(m) = 0 THEN [text] ELSE m END AS m FROM (
  SELECT conv_id, turn, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS m FROM conversations)), u AS (
  SELECT conv_id, turn, unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM s)
SELECT conv_id, turn, ((pos - 1) // 3)::BIGINT AS grp, {_strip("string_agg(x, ' ' ORDER BY pos)")} AS paragraph
FROM u GROUP BY ALL""",
    "dict_replace": f"SELECT doc_id, {_nest('text', _BY_LENGTH)} AS text FROM documents",
    "translit_fold": f"SELECT doc_id, {_nest('text', FOLD)} AS text FROM documents",
    "residual_terms": f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS position FROM (
  SELECT doc_id, regexp_extract_all({_nest('text', FOLD)}, '\\S+') AS ws FROM documents))
SELECT doc_id, position, word, array_to_string(regexp_extract_all(word, '[{RESIDUE}]'), '') AS letters FROM w
WHERE regexp_matches(word, '[{RESIDUE}]')""",
    "verse_ref_spoken": f"""WITH r AS (SELECT l_orderkey, l_linenumber, 'see BG ' || l_linenumber || '.' || l_suppkey
  || ', SB ' || l_linenumber || '.' || l_suppkey || '.0' || l_linenumber || ' and Geeta, ' || l_suppkey || '.'
  || l_linenumber || '; CC ' || l_suppkey || ' x' AS ref FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_spoken_sql('ref')} AS spoken FROM r""",
    "markdown_clean": f"SELECT doc_id, {_voice_sql('text')} AS text FROM documents",
    "voice_preprocess": f"""SELECT doc_id, {_voice_sql(_nest(_spoken_sql(_nest(
        "(text || ' (see BG ' || (n_chars % 90) || '.' || (doc_id % 90) || ')')", _BY_LENGTH)), FOLD))} AS text
FROM documents""",
    "share_format": "SELECT doc_id, 'Q: ' || source || chr(10) || chr(10) || substr("
    + _strip(_re(_re(_re("text", r"#{1,3}\s", ""), r"\*\*", ""), r"(?m)^\s*[-•]\s", "• "))
    + ", 1, 500) || '...' || chr(10) || chr(10) || '- shared' AS text FROM documents",
    "line_class": f"WITH {_FACTS.replace('SOURCE_TEXT', 'text')} SELECT doc_id, line_no, n_words, n_exclusive, n_common, "
    "n_english, verse FROM judged",
    "block_parse": f"""WITH {_FACTS.replace('SOURCE_TEXT', "regexp_replace(text, '([^" + chr(92) + "n#])(#{1,3} )', '" + chr(92) + "1' || chr(10) || '" + chr(92) + "2', 'g')")}, k AS (SELECT *, CASE
  WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^[-*_]{{3,}}$') THEN 'rule'
  WHEN starts_with(line, '> ') THEN CASE WHEN verse THEN 'verse' ELSE 'translation' END
  WHEN regexp_matches(line, '^(?:[-*•]|\\d+[.)])\\s+(.+)') THEN 'bullet'
  WHEN starts_with(line, '### ') THEN 'h3' WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '# ') THEN 'h1'
  WHEN regexp_matches(line, {_sq(VOCAB.mantra)}) THEN 'mantra'
  WHEN regexp_matches(line, {_sq(VOCAB.reference)}) THEN 'verse-ref'
  WHEN starts_with(line, '"') AND verse THEN 'quote' WHEN verse AND length(line) < 250 THEN 'verse'
  ELSE 'paragraph' END AS type FROM judged)
SELECT doc_id, line_no, type, CASE type WHEN 'h3' THEN {_strip('substr(line, 5)')} WHEN 'h2' THEN {_strip('substr(line, 4)')}
  WHEN 'h1' THEN {_strip('substr(line, 3)')} WHEN 'bullet' THEN regexp_extract(line, '^(?:[-*•]|\\d+[.)])\\s+(.+)', 1)
  WHEN 'translation' THEN regexp_replace(probe, '^["“]|["”]$', '', 'g')
  WHEN 'quote' THEN regexp_replace(line, '^"|"$', '', 'g')
  WHEN 'verse' THEN probe ELSE line END AS text,
  CASE WHEN (starts_with(line, '"') OR starts_with(line, '“')) AND n_english >= 2
  THEN regexp_replace(line, '^["“]|["”]$', '', 'g') ELSE '' END AS spoken FROM k""",
    "term_runs": f"""WITH t AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM (
  SELECT doc_id, string_split(regexp_replace(text, '(\\s)(\\S)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ts
  FROM documents)), f AS (
  SELECT *, regexp_replace(lower(tok), '[.,;:!?"''()\\[\\]{{}}\\s]', '', 'g') AS w FROM t), h AS (
  SELECT *, {_TERM} OR regexp_matches(tok, '[ñß]') AS hit FROM f), i AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, hit ORDER BY pos) AS island FROM h), g AS (
  SELECT doc_id, island, min(pos) AS lo, count(*) AS n, string_agg(tok, '' ORDER BY pos) AS phrase FROM i WHERE hit
  GROUP BY doc_id, island HAVING count(*) >= 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS run,
    len(list_filter({_tokens_sql('phrase')}, lambda w: {_TERM})) AS n_terms FROM g)
SELECT doc_id, run, phrase, n_terms FROM r WHERE n_terms >= 2""",
    "html_links": f"""WITH {_LINKS} SELECT page_id, pos, link, trim({_unescape_sql("regexp_replace(body, '<[^>]+>', '', 'g')")},
  {WS}) AS title FROM links""",
    "html_title": f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>')
  THEN {_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} ELSE 'Unknown' END AS title FROM pages""",
    "html_text": f"SELECT page_id, {_content_sql()} AS content FROM pages",
    "url_slug": """WITH s AS (SELECT page_id, regexp_matches(url, '/([^/?#]+)/?(?:[?#].*)?$') AS ok,
  regexp_extract_all(replace(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1), '-', ' '), '\\pL+|\\PL+') AS runs
  FROM pages)
SELECT page_id, CASE WHEN ok THEN array_to_string(list_transform(runs,
  lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '') ELSE 'Unknown' END AS recipient FROM s""",
    "first_seen_links": f"""WITH {_LINKS} SELECT link, page_id, pos FROM links
QUALIFY page_id = min(page_id) OVER (PARTITION BY link)""",
    "date_extract": f"""WITH t AS (SELECT o_orderkey, {_LETTER} AS text FROM orders), x AS (SELECT *, CASE
  WHEN regexp_matches(text, {_sq(_DATE_1)}) THEN regexp_extract(text, {_sq(_DATE_1)})
  WHEN regexp_matches(text, {_sq(_DATE_2)}) THEN regexp_extract(text, {_sq(_DATE_2)}) END AS date FROM t)
SELECT o_orderkey, coalesce(date, 'none') AS date, coalesce(regexp_extract(date, '\\d{{4}}'), 'unknown') AS year,
  {_strip("regexp_extract(text, '(?:Date|Location|Place):" + chr(92) + "s*([A-Z][a-zA-Z" + chr(92) + "s]+)', 1)")} AS location FROM x""",
    "title_facets": """WITH t AS (SELECT o_orderkey, 'SP BG ' || o_custkey || '-01 ' || CASE o_orderstatus WHEN 'O' THEN 'London'
    WHEN 'F' THEN 'new york' ELSE 'Rome' END || ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' '
    || floor(o_totalprice)::BIGINT || '.25 ' || CASE o_orderpriority[1] WHEN '1' THEN 'KB' WHEN '2' THEN 'GB'
    ELSE 'MB' END AS title FROM orders), x AS (SELECT *, regexp_extract(title, '([\\d.]+)\\s*(MB|KB|GB)', 1)::DOUBLE AS s,
    regexp_extract(title, '([\\d.]+)\\s*(MB|KB|GB)', 2) AS u FROM t)
SELECT o_orderkey, regexp_extract(title, '\\d{4}-\\d{2}-\\d{2}') AS date,
  CASE WHEN title LIKE '%London%' THEN 'London' WHEN title LIKE '%new york%' THEN 'new york' ELSE 'none' END AS location,
  regexp_extract(title, 'BG\\s+([\\d-]+)', 1) AS verse,
  round(CASE u WHEN 'KB' THEN s / 1024 WHEN 'GB' THEN s * 1024 ELSE s END, 4) AS size_mb FROM x""",
    "citation_label": """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'bg'
  WHEN 'N' THEN 'sb' ELSE 'cc' END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, k || '_' || l_linenumber || '_' || l_suppkey || '_' || l_partkey AS chunk,
  CASE k WHEN 'bg' THEN 'First Work, Chapter ' || l_linenumber || ', Verse ' || l_suppkey || '.' || l_partkey
  WHEN 'sb' THEN 'Second Work, Canto ' || l_linenumber || ', Chapter ' || l_suppkey || ', Verse ' || l_partkey
  ELSE 'Third Work, ' || l_linenumber || ', Chapter ' || l_suppkey || ', Text ' || l_partkey END AS label FROM t""",
    "dim_lookup": """SELECT doc_id, lang, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French'
  ELSE lang END AS name FROM documents""",
    "keyword_score": """WITH s AS (SELECT doc_id, 2 * len(list_filter(string_split_regex(text, '\\s+'),
    lambda w: contains(lower(w), 'tion'))) + CASE WHEN contains(lower(text), 'tion') THEN 3 ELSE 0 END
    + CASE WHEN contains(source, 'tion') THEN 1 ELSE 0 END AS score FROM documents)
SELECT doc_id, score::BIGINT AS score FROM s WHERE score > 0""",
}

# Cards: lines take up what stands before them, runs become blocks, cards take up what follows; row by row.
SQL["verse_cards"] = f"""WITH RECURSIVE typed AS MATERIALIZED (SELECT doc_id, line_no, type AS t, text AS x, spoken AS sp FROM ({SQL['block_parse']})),
lines(doc_id, line_no, kind, x, last, opened) AS (
  SELECT DISTINCT doc_id, -1::BIGINT, '', '', '', false FROM typed
  UNION ALL
  SELECT doc_id, n, k, y, CASE WHEN k = 'bullet' THEN 'bullet-list' WHEN k IN ('blank', 'rule') THEN CASE WHEN opened THEN 'paragraph' ELSE last END
      WHEN k = 'paragraph' THEN last ELSE k END, k = 'paragraph'
  FROM (SELECT l.doc_id, l.last, l.opened, t.line_no AS n, l.last = 'verse' AND sp <> '' AND t IN ('quote', 'verse', 'paragraph') AS turned,
      CASE WHEN turned THEN 'translation' ELSE t END AS k, CASE WHEN turned THEN sp ELSE t.x END AS y
    FROM lines l JOIN typed t ON t.doc_id = l.doc_id AND t.line_no = l.line_no + 1)),
starts AS (SELECT *, kind NOT IN ('paragraph', 'bullet') OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS new FROM lines WHERE line_no >= 0),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM starts WHERE kind NOT IN ('blank', 'rule')),
blocks AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS b, kind,
    string_agg(x, ' ' ORDER BY line_no) AS said, string_agg(x, chr(10) ORDER BY line_no) AS listed FROM runs GROUP BY doc_id, run, kind),
cards(doc_id, b, no, card, tr, rf, role) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, -1::BIGINT, false, false, false, '' FROM blocks
  UNION ALL
  SELECT doc_id, nb, no + CASE WHEN joins THEN 0 ELSE 1 END, kind IN ('verse', 'quote') OR joins,
    (joins AND tr) OR (joins AND kind = 'translation'), (joins AND rf) OR (joins AND kind = 'verse-ref'),
    CASE WHEN kind IN ('verse', 'quote') THEN 'item' WHEN kind IN ('translation', 'verse-ref') THEN kind ELSE 'block' END
  FROM (SELECT c.doc_id, c.no, c.tr, c.rf, x.b AS nb, x.kind, c.card AND (x.kind IN ('verse', 'quote')
      OR (x.kind = 'translation' AND NOT c.tr) OR (x.kind = 'verse-ref' AND NOT c.rf)) AS joins
    FROM cards c JOIN blocks x ON x.doc_id = c.doc_id AND x.b = c.b + 1))
SELECT doc_id, no AS block, CASE WHEN bool_or(role <> 'block') THEN 'verse-card' WHEN any_value(kind) = 'bullet' THEN 'bullet-list' ELSE any_value(kind) END AS type,
  CASE WHEN bool_or(role = 'block') AND any_value(kind) <> 'bullet' THEN any_value(said) END AS text,
  CASE WHEN bool_or(role <> 'block') THEN coalesce(string_agg(CASE WHEN kind = 'quote' THEN '“' || said || '”' ELSE said END, chr(10) ORDER BY b) FILTER (role = 'item'), '')
       WHEN any_value(kind) = 'bullet' THEN any_value(listed) END AS items,
  any_value(said) FILTER (role = 'translation') AS translation, any_value(said) FILTER (role = 'verse-ref') AS ref
FROM cards JOIN blocks USING (doc_id, b) GROUP BY doc_id, no"""
