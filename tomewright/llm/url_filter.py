"""URL filter: host and path rules, and decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.strings import once
from tomewright.llm.common import stored
from tomewright.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Link elements whose target is another address of the same page, RE2 and Java syntax alike.
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*['\"]?([^\"'>]+)"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """What identifies an address: host, path and query; scheme and fragment play no part."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(url_host(url), url_path(url), query)


def shown_markup(html: Column) -> Column:
    """The page without comments and scripts."""
    return F.regexp_replace(html, HIDDEN, "")


def link_targets(url: Column, shown: Column) -> Column:
    """Absolute targets of the canonical links and refresh redirects in shown mark-up."""
    canonical = F.transform(
        F.regexp_extract_all(shown, F.lit(CANONICAL_TAG), F.lit(0)),
        lambda tag: F.concat(*(F.regexp_extract(tag, HREF, g) for g in (1, 2, 3))),
    )
    refresh = F.transform(
        F.regexp_extract_all(shown, F.lit(REFRESH_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1)
    )
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:[^?#]*/)?)", 1)

    def absolute(t: Column) -> Column:
        t = F.replace(F.trim(t), F.lit("&amp;"), F.lit("&"))
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.startswith("/"), F.concat(origin, t))
            .when(t.startswith("?"), F.concat(origin, url_path(url), t))
            .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), t))
        )

    return F.transform(F.filter(F.concat(canonical, refresh), lambda t: F.trim(t) != ""), absolute)


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link or refresh redirect; pages that name neither are skipped unread."""
    naming = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    linking = naming.select("url", once(shown_markup(F.col("html"))).alias("shown"))
    links = linking.select("url", F.explode(link_targets(F.col("url"), F.col("shown"))).alias("target"))
    return links.where(F.col("target").contains("://"))


def best_rule(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, rule_verdict): the longest rule that fits each distinct (node, host, path).

    A rule fits its host and all subdomains if the path starts with the rule's. Every suffix of a host is
    joined to the rules by equality, so a rule table of any size works: Spark broadcasts it while small
    and shuffles it otherwise. Of equally long rules ``allow`` wins, then the smaller text.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # Written first, so that Spark knows how small it is and which side to broadcast.
    r = stored(rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("rule_verdict"),
        F.concat("host", "path").alias("rule"),
    ))
    fitting = (
        nodes.where("host != ''")
        .select("node", "path", F.explode(suffixes).alias("r_host"))
        .join(r, "r_host")
        .where(F.expr("startswith(path, r_path)"))
    )
    order = F.struct(F.length("rule"), F.col("rule_verdict") == "allow", F.col("rule"))
    return fitting.groupBy("node").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("r")).select("node", "r.*")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages(page_id, url, html)``.

    The verdict is that of the longest fitting rule. Where none fits, addresses joined by redirects and
    canonical links (from the pages, and from ``links(url, target)`` if given) form classes by connected
    components: a class with an allowed member is allowed, else one with a blocked member is blocked;
    all others are allowed. A null url or one without ``://`` has empty host and path, no rule and is
    allowed. Repeated rows give repeated results; a null html holds no links.
    """
    edges = page_edges(pages)
    if links is not None:
        edges = edges.unionByName(links.select("url", "target").where(F.col("url").contains("://") & F.col("target").contains("://")))
    edges = stored(edges.select(F.col("url"), F.col("target")).distinct())
    urls = (
        pages.select("url").where(F.col("url").contains("://"))
        .unionByName(edges.select("url")).unionByName(edges.select(F.col("target").alias("url")))
    )
    nodes = urls.select(url_node(F.col("url")).alias("node"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).distinct()
    ruled = stored(best_rule(nodes, rules))
    classes = connected_components(edges.select(url_node(F.col("url")).alias("a"), url_node(F.col("target")).alias("b")))
    by_class = classes.join(ruled, "node").groupBy("component").agg(
        F.when(F.max((F.col("rule_verdict") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("class_verdict")
    )
    inherited = classes.join(by_class, "component").select("node", "class_verdict")
    asked = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.when(F.col("url").contains("://"), url_node(F.col("url"))).alias("node"),
    )
    return (
        asked.join(ruled, "node", "left").join(inherited, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"))
    )


def judge_sql(rules: list[tuple[str, str, str]]) -> str:
    """The same in DuckDB: every rule against every address, classes by a recursive query."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    host = f"coalesce(translate(regexp_extract({{0}}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '')"
    path = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    node = f"{host} || {path} || regexp_extract({{0}}, '^[^?#]*(\\?[^#]*)', 1, 's')"
    q = {k: v.replace("'", "\\x27") for k, v in {"hidden": HIDDEN, "tag": CANONICAL_TAG, "meta": REFRESH_TAG, "href": HREF, "url": REFRESH_URL}.items()}
    href = " || ".join(f"regexp_extract(x, '{q['href']}', {g})" for g in (1, 2, 3))
    absolute = """CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                  WHEN t LIKE '//%' THEN 'http:' || t
                  WHEN t LIKE '/%' THEN origin || t
                  WHEN t LIKE '?%' THEN origin || path || t
                  ELSE origin || (CASE WHEN folder = '' THEN '/' ELSE folder END) || t END"""
    return f"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {values}),
shown AS (SELECT url, regexp_replace(html, '{q['hidden']}', '', 'g') AS html FROM pages
          WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
raw AS (SELECT url, unnest(list_concat(
            list_transform(regexp_extract_all(html, '{q['tag']}'), lambda x: {href}),
            list_transform(regexp_extract_all(html, '{q['meta']}'), lambda x: regexp_extract(x, '{q['url']}', 1)))) AS t FROM shown),
parts AS (SELECT url, replace(trim(t), '&amp;', '&') AS t, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin,
                 {path.format('url')} AS path, regexp_extract(url, '^.*?://[^/?#]*((?:[^?#]*/)?)', 1, 's') AS folder
          FROM raw WHERE trim(t) <> ''),
edges AS (SELECT DISTINCT url, target FROM (SELECT url, {absolute} AS target FROM parts) WHERE contains(target, '://')),
urls AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT url FROM edges UNION SELECT target FROM edges),
nodes AS (SELECT DISTINCT {node.format('url')} AS node, {host.format('url')} AS host, {path.format('url')} AS path FROM urls),
ruled AS (SELECT node, r.host || r.path AS rule, r.verdict FROM nodes n JOIN rules r
          ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(r.host || r.path) DESC, r.verdict, r.host || r.path DESC) = 1),
links AS (SELECT {node.format('url')} AS a, {node.format('target')} AS b FROM edges),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT a, a FROM sym UNION SELECT b, root FROM reach JOIN sym ON a = node),
classes AS (SELECT node, min(root) AS class FROM reach GROUP BY node),
decided AS (SELECT class, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
            FROM classes JOIN ruled USING (node) GROUP BY class),
asked AS (SELECT page_id, {host.format('url')} AS host, {path.format('url')} AS path,
                 CASE WHEN contains(url, '://') THEN {node.format('url')} END AS node FROM pages)
SELECT page_id, asked.host, asked.path, rule, coalesce(ruled.verdict, decided.verdict, 'allow') AS verdict
FROM asked LEFT JOIN ruled USING (node) LEFT JOIN classes USING (node) LEFT JOIN decided USING (class)
"""
