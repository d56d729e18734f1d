import re

from oracle import compare, duck

from tomewright.llm import url_filter as U
from tomewright.llm.catalog import URL_RULES, oracle_sql, queries

PAGES = "page_id bigint, url string, html string, lang string"


def judge(spark, rows, rules=URL_RULES, links=None, columns="page_id bigint, url string, html string"):
    df = spark.createDataFrame(rows, columns)
    links = links and spark.createDataFrame(links, "url string, target string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, U.rules_frame(spark, rules), links).collect()}


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_addresses(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://a.net?x=1", "http://a.net#f/", "https://B.Example.NET/en/x?y",
        "http://example.net/de/", "http://example.net/en", "ftp://org/fr/", "http://x.org/fr/a#b", "http://x.org/de/", "http://example.com/de/1",
        "http://sub.example.com/de/?q", "http://notexample.com/de/", "x://y://z/", "http://ÀÉ.Net/", "http://a.net\n/p", "http://a.net/é\nb?c", "http://.net/", "http://net./",
    ]
    got = judge(spark, [(k, u, "") for k, u in enumerate(urls)])
    for k, u in enumerate(urls):
        assert got[k] == by_hand(u), u


def test_aliases_share_decisions_and_allow_wins(spark):
    page = '<html><head><!-- <link rel="canonical" href="http://bad.net/c"> --><script>"<link rel=canonical href=http://bad.net/s>"</script>{}</head></html>'
    rows = [
        (1, "http://a.io/1", page.format('<link href="http://bad.net/x" rel="canonical">')),
        (2, "http://b.io/2", page.format("<META http-equiv=refresh content='0; url=http://a.io/1'>")),
        (3, "http://c.io/3", page.format("<link rel=canonical href='//b.io/2#top'>")),
        (4, "http://d.io/4", page.format("")),
        (5, "http://e.io/d/5", page.format('<link rel="canonical" href="6">')),
        (6, "http://e.io/d/6", page.format('<link rel="canonical" href="/7?a=1&amp;b=2">')),
        (7, "http://e.io/7?a=1&b=2", page.format('<link rel="canonical" href="http://z.example.net/en/">')),
        (8, "http://f.io/8", page.format('<link rel="canonical" href="http://e.io/d/5">')),
        (9, "http://q.net/9", page.format('<link rel="canonical" href="http://e.io/d/5">')),
        (10, "http://g.io/10", None),
    ]
    got = judge(spark, rows)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    got = judge(spark, [(1, "http://h.io/", ""), (2, "http://k.io/", "")], links=[("http://h.io/", "http://m.io/"), ("http://m.io/", "http://x.net/"), (None, "http://x.net/")])
    assert got[1][3] == "block" and got[2][3] == "allow"


def test_repeats_extra_columns_and_empty(spark):
    rows = [(1, "http://x.net/", None, "n", "r"), (1, "http://x.net/", None, "n", "r"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, node string, rule string")
    got = U.judge_urls(df, U.rules_frame(spark, URL_RULES)).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "block"), ("1", "block"), ("None", "allow")]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert U.judge_urls(empty, U.rules_frame(spark, URL_RULES)).count() == 0


def test_plan_has_no_python_and_no_cross_join(spark, data):
    plan = queries()["op8_url_filter"](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_sql(spark, data):
    ok, note = compare(spark, duck(data), "op8_url_filter", queries()["op8_url_filter"], oracle_sql()["op8_url_filter"], data)
    assert ok, note
