"""Fields of scraped pages, by expressions that stay in the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import fixed_values as fixed
from tomewright.functions.arrays import scan
from tomewright.functions.strings import py_strip, title_case

# Elements whose text is not content.
BOILERPLATE = ["script", "style", "nav", "header", "footer", "aside"]
# The commonest named character references; all others come from the standard's own table.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"),
    ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
]
# Characters that numbers 128 to 159 stand for on web pages.
C1_CHARACTERS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

REFERENCE = "&(#[xX][0-9A-Fa-f]{1,8}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*);"
#: The rest of a tag. Possessive, as a loop over a group that may be undone takes stack for each character; a "<" outside
#: quotes ends it, so that tags which never end are not read to the end of the page again and again.
ATTRIBUTES = "((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
#: One attribute: its name, and its value in double, single or no quotes.
ATTRIBUTE = "([^\\s=>\"'/]+)(?:\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+)))?"


def _character(ref: Column) -> Column:
    """The character a reference (without ``&`` and ``;``) stands for, null for an unknown name."""
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    number = F.when(is_hex, F.conv(F.substring(ref, 3, 10), 16, 10)).otherwise(F.substring(ref, 2, 10)).try_cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    numeric = F.when(number.between(128, 159), F.substring(F.lit(C1_CHARACTERS), (number - 127).cast("int"), F.lit(1))).otherwise(coded)
    common = F.create_map(*[F.lit(x) for r, ch in ENTITIES for x in (r[1:-1], ch)])
    named = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    return F.when(ref.startswith("#"), numeric).otherwise(F.coalesce(F.element_at(common, ref), F.element_at(named, ref)))


def unescape(c: Column) -> Column:
    """Numeric and named character references decoded once, left to right; unknown names stay."""
    pieces, refs = F.split(c, REFERENCE), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    joined = F.zip_with(
        pieces, refs, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(F.coalesce(_character(r), F.concat(F.lit("&"), r, F.lit(";")))))
    )
    return F.when(c.rlike(REFERENCE), F.array_join(joined, "")).otherwise(c)


def page_title(page: Column) -> Column:
    """Text of ``<title>``, ``Unknown`` for a page without one."""
    pattern = "(?is)<title[^>]*>(.*?)</title>"
    return F.when(page.rlike(pattern), unescape(F.regexp_extract(page, pattern, 1))).otherwise("Unknown")


def absolute_url(target: Column, base: Column, page: Column | None = None) -> Column:
    """``target`` as a whole address: root-relative ones get ``base``, others the folder of ``page`` (or base)."""
    root = F.regexp_replace(base, "/+$", "")
    folder = F.concat(root, F.lit("/"))
    if page is not None:
        path = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
        folder = F.when(path == "", folder).otherwise(F.concat(root, path))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(folder, target))
    )


def link_rows(
    pages: DataFrame, keep: list[str], href: str = "(?s).+", base: Column | None = None, skip: list[str] = (),
    title_from_target: bool = False,
) -> DataFrame:
    """``(pos, link, title)`` of anchors whose target matches ``href`` as a whole, made absolute.

    A tag is found first and its attributes are then read one by one, so quoting and order do not matter
    and names such as ``data-href`` are not taken for ``href``. Targets are decoded; those that contain one
    of ``skip`` are left out. With ``title_from_target`` an anchor without text is titled by its file's stem.
    """
    base = F.regexp_extract("url", "^(https?://[^/?#]+)", 1) if base is None else base
    anchor = f"(?is)<a(?=[\\s/>]){ATTRIBUTES}>(.*?)(?:</a>|\\z)"
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("attributes"),
        F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("body"),
    )
    pattern = F.lit("(?s)" + ATTRIBUTE)

    def target(a: Column) -> Column:
        read = F.arrays_zip(
            *(F.regexp_extract_all(a["attributes"], pattern, F.lit(g)).alias(n) for g, n in enumerate(("name", "dq", "sq", "bare"), 1))
        )
        own = F.get(F.filter(read, lambda x: F.lower(x["name"]) == "href"), F.lit(0))
        return F.concat(own["dq"], own["sq"], own["bare"])

    targets = F.filter(
        F.transform(found, lambda a: F.struct(target(a).alias("href"), a["body"].alias("body"))), lambda x: F.coalesce(x["href"], F.lit("")) != ""
    )

    def is_wanted(x: Column) -> Column:
        ok = x["href"].rlike(f"^(?:{href})$")
        for part in skip:
            ok = ok & ~x["href"].contains(part)
        return ok

    decoded = F.transform(targets, lambda x: F.struct(py_strip(unescape(x["href"])).alias("href"), x["body"].alias("body")))
    wanted = F.filter(decoded, is_wanted)
    rows = pages.select(*keep, "url", base.alias("base"), F.posexplode(wanted).alias("pos", "a"))
    title = py_strip(unescape(F.regexp_replace("a.body", "<[^>]+>", "")))
    if title_from_target:
        name = F.regexp_extract("a.href", "([^/]*)/*$", 1)
        stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
        title = F.when(title == "", stem).otherwise(title)
    return rows.select(
        *keep, F.col("pos").cast("long").alias("pos"),
        absolute_url(F.col("a.href"), F.col("base"), F.col("url")).alias("link"), title.alias("title"),
    )


def content_text(page: Column) -> Column:
    """Text pieces outside boilerplate elements, stripped, one per line.

    Scripts, styles and comments go first, as they hold no elements. The rest is cut at the tags of
    boilerplate elements and each piece kept at depth zero, so nested ones are left out whole. What is never
    closed (a comment, a script, a tag) reaches to the end of the page.
    """
    nested = [t for t in BOILERPLATE if t not in ("script", "style")]
    fence = f"(?i)<(/?)(?:{'|'.join(nested)})(?=[\\s/>]){ATTRIBUTES}>"
    mark_up = "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b[^>]*+(?:>.*?(?:</\\1\\s*>|\\z)|\\z)"
    tag = "(?s)<[/!?A-Za-z][^>]*+(?:>|\\z)"
    plain = F.regexp_replace(page, mark_up, "<!>")
    pieces = F.split(plain, fence)
    ends = F.regexp_extract_all(plain, F.lit(fence), F.lit(1))
    later = F.zip_with(F.slice(pieces, 2, F.size(pieces)), ends, lambda p, e: F.struct(e.alias("end"), p.alias("piece")))

    def depth(d: Column, x: Column) -> Column:
        return F.when(x["end"] == "", d + 1).otherwise(F.greatest(d - 1, F.lit(0)))

    inside = scan(later, F.lit(0), F.slice(F.array(F.lit("")), 1, 0), depth, lambda d, x: F.when(depth(d, x) == 0, x["piece"]).otherwise(""))
    kept = F.flatten(F.transform(F.concat(F.slice(pieces, 1, 1), inside), lambda p: F.split(p, tag)))
    texts = F.transform(kept, lambda p: py_strip(unescape(p)))
    return F.when(page.isNotNull(), F.array_join(F.filter(texts, lambda p: p != ""), "\n"))


def slug_title(url: Column, pattern: str = "/letter-to-([^/]+)/?$") -> Column:
    """Readable name from the last part of an address, ``Unknown`` where the pattern does not match."""
    slug = F.replace(F.regexp_extract(url, pattern, 1), F.lit("-"), F.lit(" "))
    return F.when(url.rlike(pattern), title_case(slug)).otherwise("Unknown")


# Date shapes tried in this order, the place line, and the facets of recording titles.
DATE_PATTERNS = [r"(?U)(\w+ \d+(?:st|nd|rd|th)?,? \d{4})", r"(?U)(\d+ \w+ \d{4})"]
PLACE_PATTERN = r"(?U)(?:Date|Location|Place):\s*([A-Z][a-zA-Z\s]+)"
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
VERSE_FACET = r"BG\s+([\d-]+)"
SIZE_FACET = r"(?i)([\d.]+)\s*(MB|KB|GB)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null when there is none; the text is matched once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def date_text(text: Column) -> Column:
    """First match of the first pattern that matches anywhere, else null."""
    return F.coalesce(*[_first(text, p) for p in DATE_PATTERNS])


def year_of(date: Column) -> Column:
    return F.coalesce(_first(date, r"(\d{4})"), F.lit("unknown"))


def place_text(text: Column) -> Column:
    return py_strip(_first(text, PLACE_PATTERN))


def title_facets(title: Column) -> dict[str, Column]:
    """Date, place, verse range and size in MB read from a recording title; missing ones are null."""
    size = F.regexp_extract(title, SIZE_FACET, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(title, SIZE_FACET, 2))
    factor = F.when(unit == "KB", 1 / 1024).when(unit == "GB", 1024.0).when(unit == "MB", 1.0)
    return {
        "date": _first(title, ISO_DATE),
        "location": _first(title, "(?i)(" + "|".join(fixed.PLACES) + ")"),
        "verse": _first(title, VERSE_FACET),
        "size_mb": F.coalesce(size * factor, F.lit(0.0)),
    }


def first_seen(links: DataFrame, page_col: str = "page_id", pos_col: str = "pos") -> DataFrame:
    """Links kept on the first page that shows them, with all repeats on that very page.

    Positions are gathered per (link, page) before links meet, so a link on every page costs one small
    row per page, merged map-side.
    """
    per_page = links.groupBy("link", page_col).agg(F.collect_list(pos_col).alias("positions"))
    first = per_page.groupBy("link").agg(F.min(F.struct(page_col, "positions")).alias("f"))
    return first.select("link", F.col(f"f.{page_col}").alias(page_col), F.explode("f.positions").alias(pos_col))
