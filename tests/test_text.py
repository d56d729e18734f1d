import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomewright.functions import html as H
from tomewright.functions import strings as S
from tomewright.functions import text as X
from tomewright.functions.numbers import py_round
from tomewright.operators import blocks as B
from tomewright.operators.chunk import chunk_conversations, chunk_documents, spans


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("o")).first().o


def test_python_string_rules(spark):
    odd = "  \x1f a  b　"
    assert one(spark, odd, S.py_strip(F.col("t"))) == odd.strip()
    assert one(spark, odd, S.word_count(F.col("t"))) == len(odd.split())
    assert one(spark, " \n", S.word_count(F.col("t"))) == 0
    assert one(spark, "o'brien mc-donald ÉTÉ", S.title_case(F.col("t"))) == "o'brien mc-donald ÉTÉ".title()
    assert one(spark, " Éa ", S.sqlite_key(F.col("t"))) == "Éa" and one(spark, " Éa\t", S.norm_key(F.col("t"))) == "éa"
    assert one(spark, "x@y.org", S.is_email(F.col("t"))) and not one(spark, "x@y", S.is_email(F.col("t")))


def test_rounding_is_that_of_python(spark):
    rows = spark.range(1, 60000).select("id", py_round(F.col("id") / 1e6 * 0.12, 4).alias("r")).collect()
    assert all(r.r == round(r.id / 1e6 * 0.12, 4) for r in rows)


def test_cleaning(spark):
    text = "\n\nkeep\nDonate now\n\n\n\nmore Privacy policy\nend  "
    assert one(spark, text, X.clean_text(F.col("t"))) == "keep\n\nend"
    for text, want in [("p one\nx\np two\ny", "p one\nx\ny"), ("x\np 1\np 2", "x\np 1"), ("none", "none"), ("p\np\np", "p")]:
        assert one(spark, text, X.keep_first_prefixed_line(F.col("t"), ["p"])) == want
    cut = X.section_slice(F.col("t"), "Translation", "Purport")
    assert one(spark, "a Translation b Purport c", cut) == "Translation b "
    assert one(spark, "Purport a Translation b", cut) == ""
    assert one(spark, "no marks", cut) == "no marks" and one(spark, "x Translation y", cut) == "Translation y"


def test_conversation_blocks(spark):
    body = "word " * 30
    text = f"=== X\nSource: s\n{body}\n750401mw.may\n—\nTitle one\n{body}\n  750402MW.MAY  \nlast line\n{body}\n750403rc.may\nshort"
    df = spark.createDataFrame([(1975, "may", text)], "year int, month string, text string")
    got = sorted(X.conversation_blocks(df, skip_patterns=["==="]).collect(), key=lambda r: r.block)
    assert [r.conv_id for r in got] == ["1975_may_main", "750401mw.may", "750402MW.MAY"]
    assert got[1].title.startswith("Title one word") and "750402MW.MAY" in got[1].title
    assert got[0].body == body.strip() and got[1].body.startswith("—\nTitle one\n")


def packer(sizes, limit, carry):
    """Greedy packing told sentence by sentence."""
    out, cur, words = [], [], 0
    for i, n in enumerate(sizes):
        if words + n > limit and cur:
            out.append((cur[0], cur[-1] + 1))
            cur = cur[-carry:]
            words = sum(sizes[j] for j in cur)
        cur.append(i)
        words += n
    if cur:
        out.append((cur[0], cur[-1] + 1))
    return out


def test_spans_equal_greedy_packing_and_cover_all(spark):
    rng = random.Random(3)
    cases = [([rng.randint(0, 30) for _ in range(rng.randint(1, 60))], limit, carry) for limit in (5, 20, 41, 80) for _ in range(30) for carry in (1, 2, 3)]
    cases += [([], 20, 3), ([99], 20, 3), ([99] * 5, 20, 3)]
    for limit in {c[1] for c in cases}:
        for carry in (1, 2, 3):
            mine = [c[0] for c in cases if c[1:] == (limit, carry)]
            if not mine:
                continue
            df = spark.createDataFrame([(x,) for x in mine], "sizes array<bigint>").coalesce(1)
            for row in df.select("sizes", spans(F.col("sizes"), limit, carry).alias("r")).collect():
                got = [tuple(r) for r in row.r]
                assert got == (packer(row.sizes, limit, carry) if row.sizes else [])
                assert set(i for a, b in got for i in range(a, b)) == set(range(len(row.sizes)))


def test_chunks_need_no_python(spark):
    plan = chunk_documents(spark.createDataFrame([(1, "a b. c d.")], "id int, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunk_texts(spark):
    df = spark.createDataFrame([(1, "a b. c d. e f."), (2, "")], "id int, text string")
    got = sorted((r.id, r.chunk_id, r.text) for r in chunk_documents(df, max_words=4, carry=1).collect())
    assert got == [(1, 0, "a b. c d."), (1, 1, "c d. e f.."), (2, 0, ".")]
    df = spark.createDataFrame([("750401mw.may", 1975, "may", "Is it? Yes.  No!  ")], "conv_id string, year int, month string, text string")
    got = [r.text for r in chunk_conversations(df, max_words=2, carry=2).collect()]
    assert got == ["[Conversations, 1975 MAY, 750401mw.may] Is it?", "[Conversations, 1975 MAY, 750401mw.may] Is it? Yes.", "[Conversations, 1975 MAY, 750401mw.may] Is it? Yes. No!"]


def test_spoken_forms(spark):
    f = X.spoken_references(F.col("t"))
    assert one(spark, "SB 10.14.8, BG 2.20 and BG 2.79", f) == (
        "Shreemad Bhaagavatam, canto ten, chapter fourteen, verse eight, Bhagavad Geeta, chapter two, verse twenty "
        "and Bhagavad Geeta, chapter two, verse 79"
    )
    assert one(spark, "Geeta, 02.88 xBG 1.1", f) == "Geeta, chapter two, verse 88 xBG 1.1"
    words = X.number_words()
    assert len(words) == 86 and words["21"] == "twenty-one" and words["85"] == "eighty-five" and "91" not in words
    terms = {"jñāna": "gyaana", "jñāna-yoga": "gyaana yoga"}
    said = one(spark, "**jñāna-yoga** (see BG 2.47); kṛṣ — [x] # y", X.preprocess_for_voice(F.col("t"), terms))
    assert said == "gyaana yoga , see Bhagavad Geeta, chapter two, verse forty-seven,. krish , x y"
    df = spark.createDataFrame([("ok Ārya ok",)], "t string")
    rows = X.residual_rows(df, X.transliterate(F.col("t")), []).collect()
    assert [(r.position, r.word, r.letters) for r in rows] == [(1, "Ārya", "Ā")]


def test_verse_lines(spark):
    v = X.Vocabulary()
    for line, want in [
        ("short", False), ("tattva viveka vairagya purusha", True), ("karma is in the book of yoga", False),
        ("krishna rama govinda", True), ("this is a plain English sentence", False), ("yadā hi plain english is the", True),
    ]:
        got = one(spark, line, F.transform(X.line_facts(F.array("t"), v), X.is_verse)[0])
        assert got is want, line


def test_blocks_and_cards(spark):
    text = "\n".join([
        "# Head", "one", "two ## Inline", "- a", "2) b", "after", "", "tattva viveka vairagya purusha",
        'para one', '"this is the meaning"', "BG 2.47", "BG 2.48", "---", "> not a verse at all", "> tattva viveka vidya",
        "“That is in the book”", '"tattva viveka vidya avidya"', "Hare Krishna Hare Krishna Krishna Krishna Hare Hare",
    ])
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [(r.type, r.text, r.items, r.translation, r.ref) for r in B.card_rows(df, "t", ["id"], X.Vocabulary()).orderBy("block").collect()]
    assert got == [
        ("h1", "Head", None, None, None),
        ("paragraph", "one two", None, None, None),
        ("h2", "Inline", None, None, None),
        ("bullet-list", None, ["a", "b"], None, None),
        ("paragraph", "after", None, None, None),
        ("verse-card", None, ["tattva viveka vairagya purusha"], None, None),
        ("paragraph", "para one", None, None, None),
        ("verse-card", None, [], "this is the meaning", None),
        ("verse-card", None, [], None, "BG 2.47"),
        ("verse-card", None, [], None, "BG 2.48"),
        ("verse-card", None, [], "not a verse at all", None),
        ("verse-card", None, ["tattva viveka vidya", "“tattva viveka vidya avidya”"], "That is in the book", None),
        ("mantra", "Hare Krishna Hare Krishna Krishna Krishna Hare Hare", None, None, None),
    ]


def test_spoken_blocks(spark):
    text = "One a. Two b. Three c! Four d? tattva viveka vairagya purusha. Five e. tail"
    df = spark.createDataFrame([(1, text), (2, "no end marks"), (3, "x\n- y")], "id int, t string")
    rows = B.spoken_rows(df, "t", ["id"], X.Vocabulary()).orderBy("id", "block").collect()
    assert [(r.id, r.type, r.text) for r in rows] == [
        (1, "paragraph", "One a.  Two b.  Three c!"),
        (1, "paragraph", "Four d?  tattva viveka vairagya purusha.  Five e."),
        (2, "paragraph", "no end marks"),
        (3, "paragraph", "x"),
        (3, "bullet-list", None),
    ]


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>A &amp; B</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/n'>n</a>"
        "</nav><!-- c --><p> Dear <b>x</b>,&nbsp;</p><a href=\"/en/letter-to-mary-ann/\">Mary&#39;s</a><footer>f</footer></body></html>"
    )
    df = spark.createDataFrame([("https://h.org/p?q", page)], "url string, html string")
    assert one(spark, page, H.page_title(F.col("t"))) == "A & B" and one(spark, "x", H.page_title(F.col("t"))) == "Unknown"
    want = "A & B\nDear\nx\n,\nMary's"
    assert one(spark, page, H.content_text(F.col("t"))) == want
    links = H.link_rows(df, [], href=".*/letter-to-.*").collect()
    assert [(r.link, r.title) for r in links] == [("https://h.org/en/letter-to-mary-ann/", "Mary's")]
    assert one(spark, links[0].link, H.slug_title(F.col("t"))) == "Mary Ann"
    assert one(spark, "sent July 12th, 1947 or 3 May 1950", H.date_text(F.col("t"))) == "July 12th, 1947"
    assert one(spark, "Location: New Delhi", H.place_text(F.col("t"))) == "New Delhi"
    facets = H.title_facets(F.col("t"))
    title = "SP BG 01-05 los angeles 1973-07-07 2 GB"
    got = spark.createDataFrame([(title,)], "t string").select(*[c.alias(n) for n, c in facets.items()]).first()
    assert tuple(got) == ("1973-07-07", "los angeles", "01-05", 2048.0)


@pytest.mark.parametrize("ref,want", [
    ("&eacute;&#8217;&#x1F642;", "é’🙂"), ("&amp;lt;", "&lt;"), ("&unknown; & &amp", "&unknown; & &amp"), ("&#150;&#0;&#xD800;", "–\ufffd\ufffd"),
    ("&NotEqualTilde;", "≂̸"), ("plain", "plain"), ("&Eacute;&nbsp;", "É\xa0"), (None, None), ("", ""),
])
def test_references(spark, ref, want):
    assert one(spark, ref, H.unescape(F.col("t"))) == want


def test_links_of_every_form(spark):
    page = (
        "<a href='/one'>1</a><a data-href=\"/no\" href=\"/two?a=1&amp;b=2\">2</a><A HREF=three.html>3</A><a title=\"x href='/no'\" href='//o.org/4'>4</a>"
        "<a name=x>none</a><abbr href='/no'>n</abbr><a href='http://p.org/5#f'>&eacute;</a><a href='/audio/file.name.mp3'> <img></a><a href='/index.php?q=m&m=1'>p</a>"
    )
    df = spark.createDataFrame([("https://h.org/d/p.html?q", page)], "url string, html string")
    got = [(r.link, r.title) for r in H.link_rows(df, [], skip=["index.php?q=m"], title_from_target=True).orderBy("pos").collect()]
    assert got == [
        ("https://h.org/one", "1"), ("https://h.org/two?a=1&b=2", "2"), ("https://h.org/d/three.html", "3"), ("https://o.org/4", "4"),
        ("http://p.org/5#f", "é"), ("https://h.org/audio/file.name.mp3", "file.name"),
    ]


def test_nested_boilerplate(spark):
    page = "a<nav>b<nav>c</nav>d</nav>e<header class=\"x>y\">f</header></footer>g<script>'<nav>'</script>h<aside><p>i</aside>j < k<navy>l</navy>\x00m"
    assert one(spark, page, H.content_text(F.col("t"))) == "a\ne\ng\nh\nj < k\nl\n\x00m"
    assert one(spark, None, H.content_text(F.col("t"))) is None and one(spark, "", H.content_text(F.col("t"))) == ""


def test_marks_in_the_text_itself(spark):
    text = "icon \ue000 then BG 2.20 end \ue001\ue002"
    assert one(spark, text, X.spoken_references(F.col("t"))) == "icon \ue000 then Bhagavad Geeta, chapter two, verse twenty end \ue001\ue002"
    df = spark.createDataFrame([("krishna rama \ue000 then hare \ue001krishna \ue002",)], "t string")
    assert [r.phrase for r in X.term_runs(df, "t", [], X.Vocabulary()).collect()] == ["krishna rama "]


def test_source_lines(spark):
    for line, want in [("Srila someone said", True), ("— Bhagavad", True), ("—Srimad", True), ("SB 1.2", True), ("Sri", True), ("the BG", False), ("Bhakti", False)]:
        assert one(spark, line, F.col("t").rlike(X.Vocabulary().reference)) is want, line


def test_first_page_keeps_its_own_repeats(spark):
    rows = [("a", 2, 0), ("a", 1, 0), ("a", 1, 3), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "link string, page_id bigint, pos bigint")
    assert sorted(tuple(r) for r in H.first_seen(df).collect()) == [("a", 1, 0), ("a", 1, 3), ("b", 2, 1)]


@pytest.mark.parametrize("chunk,code,want", [
    ("bg_2_47", "bg", "N, Chapter 2, Verse 47"), ("bg_2", "bg", "N"), ("sb_1_2_6_7", "SB", "N, Canto 1, Chapter 2, Verse 6.7"),
    ("cc_adi_1_3", "cc", "N, Adi-lila, Chapter 1, Text 3"), ("letters_to_x", "letters", "N (to x)"), (None, "bg", "N"), ("7", "kb", "N"),
])
def test_citations(spark, chunk, code, want):
    df = spark.createDataFrame([(code, chunk)], "c string, i string")
    assert df.select(X.citation_label(F.col("c"), F.col("i"), F.lit("N")).alias("o")).first().o == want


@pytest.mark.parametrize(
    "page, text, links",
    [
        ("<a data-x=" + "y" * 1_000_000 + " href='/one'>1</a><nav " + "z" * 1_000_000 + ">n</nav>end", "1\nend", ["https://h.org/one"]),
        ("<a " + "x='1' " * 170_000 + "href='/one'>1</a>end", "1\nend", ["https://h.org/one"]),
        ("<a " + '"' * 999_999 + "<p>after</p>", None, []),
        ("<p>a</p>" + '<a href="' * 100_000, None, []),
        ("<nav title=it's>menu</nav><p>it's</p><a href='/two'>2</a>", None, None),
    ],
)
def test_ugly_tags_take_neither_stack_nor_square_time(spark, page, text, links):
    df = spark.createDataFrame([("https://h.org/p", page)], "url string, html string")
    got = df.select(H.content_text(F.col("html")).alias("t")).first().t
    found = [r.link for r in H.link_rows(df, ["url"]).collect()]
    assert text is None or got == text
    assert links is None or found == links


def test_scan_equals_a_loop(spark):
    from tomewright.functions.arrays import scan

    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 16, 17, 100, 1001])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = df.select("k", scan(F.col("x"), F.lit(0), F.slice(F.array(F.lit(0)), 1, 0), lambda s, x: (s + x) % 7, lambda s, x: s * 10 + x).alias("o"))
    want = {}
    for k, x in rows:
        s, out = 0, None if x is None else []
        for v in x or []:
            out.append(s * 10 + v)
            s = (s + v) % 7
        want[k] = out
    assert {r.k: r.o for r in got.collect()} == want


def test_many_lines_and_many_tags_in_linear_time(spark):
    from tomewright.operators import blocks as BL

    rng = random.Random(2)
    kinds = ["verse", "quote", "paragraph", "blank", "rule", "bullet", "h1"]
    lines = [(rng.choice(kinds), f"t{i}", f"s{i}" if rng.random() < 0.6 else None) for i in range(200_000)]
    df = spark.createDataFrame([(lines,), (lines[:50],), ([],)], "l array<struct<type:string,text:string,spoken:string>>")
    got = [r.o for r in df.select(BL.resolved_lines(F.col("l")).alias("o")).collect()]
    last, open_, want = "", False, []
    for type_, text, spoken in lines:
        turned = spoken is not None and type_ in ("quote", "verse", "paragraph") and last == "verse"
        kind = "translation" if turned else type_
        want.append((kind, spoken if turned else text, spoken))
        finished = "paragraph" if open_ else last
        last = "bullet-list" if kind == "bullet" else finished if kind in ("blank", "rule") else last if kind == "paragraph" else kind
        open_ = kind == "paragraph"
    assert sorted(([tuple(x) for x in o] for o in got), key=len) == [[], want[:50], want]
    page = "<nav>no</nav>yes" * 60_000
    text = spark.createDataFrame([(page,)], "html string").select(H.content_text(F.col("html")).alias("t")).first().t
    assert text == "\n".join(["yes"] * 60_000)


@pytest.mark.parametrize("n", [5, 10_000])
def test_term_dictionary_of_any_size_equals_the_loop(spark, n):
    rng = random.Random(n)
    letters = "abcdé"
    terms = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): "".join(rng.choice(letters + "$\\") for _ in range(rng.randint(0, 4))) for _ in range(n)}
    if n > 64:  # one letter alone would replace everything
        terms = {k: v for k, v in terms.items() if len(k) > 3}
    texts = ["".join(rng.choice(letters + " ") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = df.select("k", X.replace_terms(F.col("t"), terms).alias("o"))
    want = {}
    for k, t in enumerate(texts):
        for term, by in sorted(terms.items(), key=lambda kv: -len(kv[0])):
            t = t and t.replace(term, by)
        want[k] = t
    assert {r.k: r.o for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == (1 if n > 64 else 0) and len(plan) < 5_000


def test_cards_are_folded_in_portions():
    text = [{"type": "verse" if i % 3 else "translation", "text": f"{i:06d}", "items": None, "translation": None, "ref": None} for i in range(60)]
    kind = B.to_arrow_type(B._BLOCKS)
    rows = pa.concat_arrays([pa.array([text, None, []] * 500, kind)] * 3)
    pa_before = pa.total_allocated_bytes()
    tracemalloc.start()
    got = B.folded(B.verse_cards, rows)
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert peak < 20  # as Python objects all rows take 60 MB and more
    assert len(got) == 4500 and pa.total_allocated_bytes() - pa_before < 4 * rows.nbytes
    assert got[0].as_py() == got[-3].as_py() == B.verse_cards([dict(b) for b in text]) and got[1].as_py() is None and got[2].as_py() == []


@pytest.mark.parametrize("name", ["citation_label", "dim_lookup"])
def test_names_go_to_the_rows(spark, data, name):
    """A join by a handful of keys must not shuffle the rows to as many tasks."""
    from tomewright.catalog import corpus_text

    plan = corpus_text.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cards_are_worked_out_once(spark, data):
    """Spark infers a filter on what it explodes and would fold the cards again for it, in a second Python process."""
    from tomewright.catalog import corpus_text

    spoken = B.spoken_rows(spark.createDataFrame([(1, "a b. c d.")], "id int, t string"), "t", ["id"], X.Vocabulary())
    for df, times in ((corpus_text.verse_cards(spark, data), 1), (spoken, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == times
