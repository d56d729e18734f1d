import html
import re
import time

import pytest

from tomewright.llm import html_extract as H
from tomewright.llm.catalog import queries

PAGES = "page_id bigint, url string, html string"


def article_by_hand(page):
    """Blocks of the one article of the test pages, by plain cuts."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"<h1>|</h1>|<p>|</p>|<br>", m[1]) if m else []
    return "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks) if b)


def test_test_pages(spark):
    d = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, article_by_hand(r.html)) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries()["op9_template_extraction"](spark, d).collect()}
    assert {k: (u, t) for k, (u, t, _) in got.items()} == want and all(n == len(t) for _, t, n in got.values())


def extract(spark, rows):
    return {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>m</nav><main><p>a<p>b</main><footer>f</footer>", "a\nb"),
        ("<header>h</header><article><header><h1>T</h1></header><p>x &eacute;&#8217;&amp;lt;</p></article>", "T\nx é’&lt;"),
        ("<article><p>a <b>b</b>\n c</p><nav>n<nav>deep</nav>n</nav><p>d</article>", "a b c\nd"),
        ("<article><p>a<section class='post comments'><p>cm</section><div id=sidebar>s</div><div class='ad-box'>x</div><p>z</article>", "a\nz"),
        ("<article>a<form><label>f</label></form><script>'</article>'</script><style>p{}</style><aside>s</aside>b</article>", "a\nb"),
        ("<article><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2</table></article>", "x\ny\nz\n1\n2"),
        ("<div class=cookie-notice>c</div><div class=content><p>a</div><div>rest</div>", "a"),
        ("<p>only <i>text</i></p>tail", "only text\ntail"),
        ("<article><p>a < b</p><p>un<div>closed", "a < b\nun\nclosed"),
        ("<article><p>a</p><!-- <p>hidden</p> --><p>b<br>c<img src=x>d</p></article", "a\nb cd"),
        ("<title>t</title><body><p>b</p><di", "b"),
        ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
        ("<ARTICLE><P CLASS=\"x>y\">q</P></ARTICLE>", "q"),
        ("", ""), (None, ""), ("<script>never closed", ""), ("   ", ""),
    ],
)
def test_one_page(page, text):
    assert H.extract_text(page or "", H.Parser(), H.Template(None), True) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='single no-sidebar'><p>a</p></body>", "a"),
        ("<body class=search><div>x</div><article><p>a</article></body>", "a"),
        ("<p>top</p><div class='content has-sidebar'><article><p>a</article></div>", "a"),
        ("<p>top</p><article class='post comments-open'><p>a<div class=comments><article>c</article></div></article>", "a"),
        ("<p>top of page</p><div class='sidebar-layout'><article><p>a</article></div>", "a"),
        ("<p>top of page</p><div class='header-sticky'><main><p>a</main></div>", "a"),
        ("<form id=form1><div><article><p>a</p><div class=ad>x</div></article></div></form>", "a"),
        ("<article><p>a</article><div class=sidebar><article>teaser</article></div><article class=promo>p</article>", "a"),
        ("<div class=entry>the story</div><div class=comments><article>c</article></div>", "the story"),
        ("<main>crumb<div class='search-page'><article><p>the story</article></div></main>", "the story"),
        ("<div class='notice-text'><p>a</p></div><nav>n</nav><div class=site-footer>f</div>", "a"),
        ("<article><div class=notice><p>a</div></article>", "a"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</article>", "if x=2 holds"),
        ("<noscript>n</noscript><article><p>a<noscript><p>b</noscript></article>", "a\nb"),
        ("<p>a</p><div class=site-footer>f</div><div class=main-nav>m</div><div class='cookie-bar'>c</div>", "a"),
    ],
)
def test_names_are_hints(page, text):
    assert H.extract_text(page, H.Parser(), H.Template(None), True) == text


def test_template_overrules_a_name(spark):
    rows = [(k, f"http://a.io/{k}", f"<div>All about us</div><div class='notice-body'><p>story {k}</p></div>") for k in range(12)]
    assert extract(spark, rows) == {k: f"story {k}" for k in range(12)}


def page(k, title="t"):
    return f"<html><body><div><span>Site name</span></div><div><p>By the editors</p><p>story {k} one</p><p>story {k} two</p></div><div><p>All about us</p></div></body></html>"


def test_template_text_of_a_host_is_dropped(spark):
    rows = [(k, f"http://a.io/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://b.io/{k}", page(k)) for k in range(3)]
    rows += [(200 + k, f"http://c.io/{k}", page(7)) for k in range(20)]  # copies of one page tell nothing
    got = extract(spark, rows)
    assert got[3] == "story 3 one\nstory 3 two"
    assert got[101] == "Site name\nBy the editors\nstory 1 one\nstory 1 two\nAll about us"
    assert got[205].startswith("Site name")


def test_template_text_missing_once_or_shown_twice_is_dropped(spark):
    menu, foot = "<div><div>Home of all</div></div>", "<div><p>All about us</p></div>"
    rows = [(k, f"http://a.io/{k}", f"{menu}<div><p>story {k}</p></div>{menu}{foot}") for k in range(19)]
    rows += [(19, "http://a.io/19", "<div><p>not found</p></div>")]
    rows += [(20 + k, "http://a.io/copy", rows[7][2]) for k in range(40)]  # copies make no text frequent
    assert extract(spark, rows) == {k: "not found" if k == 19 else f"story {7 if k >= 20 else k}" for k in range(60)}


def test_text_that_many_articles_share_stays(spark):
    rows = [(k, f"http://a.io/{k}", f"<div>{k} visits</div><article><p>story {k % 3 // 2}</p></article>") for k in range(21)]
    assert extract(spark, rows) == {k: f"story {k % 3 // 2}" for k in range(21)}


def test_equal_occurrence_vectors_have_equal_digests(spark):
    rows = [("h", "<div><p>a</p></div>"), ("h", "<div><p>a</p><p>b</p></div><div>c</div>"), ("h", "<p>z</p>"), ("g", "<div>q</div>")]
    counts = H.occurrence_counts(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()
    vectors = {}
    for host in "gh":
        pages = [x for h, x in rows if h == host]
        for token in {r.token for r in counts if r.host == host}:
            vectors[host, token] = tuple(1 if token == H.ROOT else sum(t == token for t, *_ in H.Parser().walk(x)) for x in pages)
    for a in counts:
        assert a.pages == sum(v > 0 for v in vectors[a.host, a.token])
        for b in counts:
            if a.host == b.host:
                assert ((a.low, a.high) == (b.low, b.high)) == (vectors[a.host, a.token] == vectors[b.host, b.token])


def test_edges(spark):
    rows = [(1, None, None, "x", "y"), (2, "no scheme", "<p>a</p>", "x", "y"), (2, "no scheme", "<p>a</p>", "x", "y"), (None, "http://q/", "", "x", "y")]
    df = spark.createDataFrame(rows, PAGES + ", host string, classes string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert got == [("1", "None", "", 0), ("2", "no scheme", "a", 1), ("2", "no scheme", "a", 1), ("None", "http://q/", "", 0)]
    assert H.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="x>a</p><p class="y">b</p></article>', "a\nb"),
        ('<article><p class="x>She said "yes" twice</p><p>b</p></article>', 'She said "yes" twice\nb'),
        ("<article><p title=it's>a</p><p title='it>b</p><p it's>c</p></article>", "a\nb\nc"),
        ('<article><p title="1 > 2" data-tip="<b>no</b>">a</p><a class="u"id="v" href="?q=">b</a></article>', "a\nb"),
        ("<article><p id = 'x' hidden = >a</p><p =>b</p></article>", "a\nb"),
        ("<article><p>a &lt; b < c</p><p>d</article><p class='", "a < b < c\nd"),
    ],
)
def test_ugly_tags_leave_no_markup(page, text):
    blocks = [t for _, _, t, _, content in H.Parser().walk(page) if t and content == 3]
    assert "\n".join(blocks) == text


@pytest.mark.parametrize(
    "page",
    ['<p class="x>a</p>' * 60_000, "<p title='x>a" * 60_000, '<p "' * 250_000, "<p a=\"'" * 120_000, "<a x=" + "y" * 1_000_000, "<!x" * 300_000, "<!--" * 250_000, "<p " + "= \" ' " * 170_000 + ">t"],
)
def test_ugly_tags_take_linear_time(page):
    start = time.process_time()
    sum(1 for _ in H.Parser().walk(page))
    assert time.process_time() - start < 5
