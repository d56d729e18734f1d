"""Main text of web pages by template deduction over pages of the same host."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import small_batches, stored
from tomewright.llm.url_filter import url_host

#: A quoted value. It ends at the next quote of its kind if a tag goes on there; else its quote was never closed and it
#: ends with the tag. A quote elsewhere than behind "=" is part of a name or of a bare value, as browsers have it.
_VALUE = r"{0}(?:[^{0}]*+(?<!=){0}(?=[\s/>]|\Z)|[^{0}>]*+)"
ATTRIBUTES = rf"""(?:[^>=]++|=\s*+(?:{_VALUE.format('"')}|{_VALUE.format("'")}|[^\s>"'][^\s>]*+)?+)*+"""
#: Comments, tags and declarations; what the page ends in reaches to its end. Nothing is undone, so time is linear.
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)({ATTRIBUTES})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A tag of which the end of the page leaves a slash only.
CUT_TAG = re.compile(r"</\Z")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")

# HTML element names by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math semantics maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr mlabeledtr munder munderover".split()
)
#: Inline elements that stand apart from the text before them.
GAPS = frozenset("br mtd mtr mlabeledtr".split())
#: A formula once more in another notation.
NOTES = frozenset("annotation annotation-xml".split())
NEVER = frozenset("head nav footer aside button select option datalist dialog".split()) | RAW
#: Whole class, id and role names, and first words of such names, that mark page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adsense advert adverts advertisement "
    "advertisements banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal newsletter "
    "subscribe subscription login signup comment comments commentlist respond reply replies disqus complementary "
    "contentinfo search form skip".split()
)
#: Words that mark furniture at the end of a name too (site-footer), and furniture that has articles of its own.
TAILS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer comments".split())
REMARKS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: A name with one of these tells how a page looks (no-sidebar, comments-open), not what the element is.
STATES = frozenset("no not has have with without is hide show open opened closed on off enabled disabled hidden visible collapsed free less none".split())
#: Elements that are never furniture by their names.
WHOLE = frozenset("html body main".split())
#: Page heads are furniture outside the article only: an article's own head holds its title.
HEADS = frozenset("header masthead topbar".split())
CONTENT = frozenset("article main content post entry story".split())
#: Elements that an opening tag of the same set closes.
CLOSES = {t: frozenset(s.split()) for t, s in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
BLOCKS_CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
for _tag in BLOCKS_CLOSE_P:
    CLOSES[_tag] = CLOSES.get(_tag, frozenset()) | {"p"}
FENCES = frozenset("ul ol table dl article section div main body td th blockquote aside nav".split())

#: What stands above a text: nothing; named furniture that holds the article or main around it (by a name's first
#: word, or plainly); a page's head; furniture by name, the same plainly, inside an article; furniture by element.
KEEP, LIFT, LIFT_PLAIN, HEAD, NAMED, PLAIN, INNER, FURNISH = range(8)
ROOT = 0  # token every page has once

COUNTS = "host string, token bigint, parent bigint, pages bigint, low bigint, high bigint, distinct_pages double"


def _token(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


class Element:
    __slots__ = ("tag", "token", "role", "content")

    def __init__(self, tag: str, token: int, role: int, content: int):
        self.tag, self.token, self.role, self.content = tag, token, role, content


class Parser:
    """Walks a page's markup and yields its elements and text blocks, each with the token of its place.

    The place of an element is the path of block elements above it with their class and id names, so the
    token tells apart equal tags in different parts of a page. Unclosed elements end as in browsers.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, int, int]] = {}

    def place(self, parent: int, tag: str, attributes: str) -> tuple[int, int, int]:
        """(token, role, content rank) of an element."""
        key = (parent, tag, attributes)
        found = self.known.get(key)
        if found is None:
            names: list[str] = []
            role = FURNISH if tag in NEVER else NAMED if tag == "form" else HEAD if tag == "header" else KEEP
            if attributes:
                for m in NAMES.finditer(attributes):
                    for name in (m[2] or m[3] or m[4] or "").lower().split():
                        words = WORD.findall(name)
                        names += words
                        if tag not in WHOLE:
                            role = max(role, self.named(words))
            words = set(names)
            content = 3 if tag == "article" else 2 if tag == "main" else 1 if words & CONTENT and tag != "body" else 0
            found = (_token(parent, tag, *names), role, content)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = found
        return found

    @staticmethod
    def named(words: list[str]) -> int:
        """Role of one class, id or role name."""
        if not words or STATES.intersection(words):
            return KEEP
        if words[0] in FURNITURE or words[-1] in TAILS:
            return PLAIN if len(words) == 1 or words[-1] in TAILS or not REMARKS.isdisjoint(words) else NAMED
        return HEAD if words[0] in HEADS or words[-1] in HEADS else KEEP

    @staticmethod
    def below(top: Element, own: int, content: int) -> int:
        """Role of an element by its own one and what stands above; ``content`` is its own rank.

        Furniture by name may hold the page's article: what it holds is marked to be lifted. Named furniture
        inside an article is no holder of another.
        """
        if FURNISH in (own, top.role):
            return FURNISH
        if own == HEAD and top.content >= 2:
            own = KEEP
        if top.role == INNER or own and top.content == 3:
            return INNER
        role = own if top.role in (KEEP, LIFT, LIFT_PLAIN) and own else max(own, top.role)
        return (LIFT_PLAIN if role == PLAIN else LIFT) if content >= 2 and role >= HEAD else role

    @staticmethod
    def end_of(tag: str, page: str, at: int) -> int:
        end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
        return end.end() if end else len(page)

    def walk(self, page: str) -> Iterator[tuple[int, int, str | None, int, int]]:
        """(token, parent, text or None, role, content rank): elements have no text, blocks of text have one.

        The role tells what furniture stands above; the content rank is that of the best element above.
        """
        stack = [Element("", ROOT, KEEP, 0)]
        text: list[str] = []
        at, n = 0, len(page)

        def block():
            top = stack[-1]
            joined = SPACES.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if joined:
                yield _token(top.token, "text", joined), top.token, joined, top.role, top.content

        for m in iter(lambda: MARKUP.search(page, at), None):
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag in GAPS:
                    text.append(" ")
                continue
            if tag in NOTES:
                if not m[1] and not m[3].endswith("/"):
                    at = self.end_of(tag, page, at)
                continue
            yield from block()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
                continue
            closes = CLOSES.get(tag)
            if closes:
                depth = len(stack) - 1
                while depth > 0 and stack[depth].tag not in FENCES - closes:
                    if stack[depth].tag in closes:
                        del stack[depth:]
                        break
                    depth -= 1
            top = stack[-1]
            token, role, content = self.place(top.token, tag, m[3])
            role = self.below(top, role, content)
            raw = tag in RAW or tag == "noscript" and top.content < 2
            yield token, top.token, None, role, max(content, top.content)
            if raw:
                at = self.end_of(tag, page, at)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(Element(tag, token, role, max(content, top.content)))
        if at < n:
            text.append(CUT_TAG.sub("", page[at:]))
        yield from block()


def occurrence_counts(pages: DataFrame) -> DataFrame:
    """Per host and token: pages that hold it and a digest of its occurrence vector, summed before the shuffle.

    The vector lists how often the token occurs on each page. Its digest is the sum of a hash of (page,
    count) over pages, so it can be added up anywhere in any order; tokens with equal vectors have equal
    digests, however many pages the host has.

    A column ``copies``, where there is one, tells how many rows hold the same page: ``distinct_pages`` counts
    them as one, each with its share of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, value, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                page = value.as_py() or ""
                digest = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))
                seen: dict[int, list[int]] = {ROOT: [1, ROOT]}
                for token, parent, *_ in parser.walk(page):
                    found = seen.setdefault(token, [0, parent])
                    found[0] += 1
                hashes: dict[int, int] = {}
                for token, (times, parent) in seen.items():
                    h = hashes.get(times)
                    if h is None:
                        h = hashes[times] = xxhash.xxh3_64_intdigest(digest.to_bytes(8, "little"), times)
                    row = sums.setdefault((host, token), [parent, 0, 0, 0, 0.0])
                    row[1] += 1
                    row[2] += h & 0xFFFFFFFF
                    row[3] += h >> 32
                    row[4] += 1 / copies
            keys, rows = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.float64()),
                ],
                names=["host", "token", "parent", "pages", "low", "high", "distinct_pages"],
            )

    copies = F.coalesce("copies", F.lit(1)) if "copies" in pages.columns else F.lit(1)
    sums = small_batches(pages.select("host", "html", copies.cast("bigint").alias("copies"))).mapInArrow(count, COUNTS)
    return sums.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"),
        F.sum("distinct_pages").alias("distinct_pages"),
    )


def host_templates(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, n_pages, tokens): tokens on at least ``share`` of a host's different pages with their equivalence class.

    Tokens with the same occurrence vector are a class. At most ``1 / share`` times the tokens of an average
    page remain for each host, whatever the number of its pages.
    """
    counts = occurrence_counts(pages)
    root = F.col("token") == ROOT
    common = stored(counts.where((F.col("pages") > 1)))
    whole = common.where(root).select("host", F.col("distinct_pages").alias("n_pages"))
    frequent = common.join(whole, "host").where(F.col("distinct_pages") >= F.col("n_pages") * share - 1e-6)
    sized = frequent.groupBy("host", "low", "high").agg(F.first("n_pages").alias("n_pages"), F.collect_list(F.struct("token", "parent")).alias("tokens"))
    return (
        sized.groupBy("host")
        .agg(F.max("n_pages").alias("n_pages"), F.collect_list("tokens").alias("classes"))
    )


class Template:
    """The nested classes of a host: those whose tokens stand in the page's class or in a nested one."""

    def __init__(self, classes: list[list[dict]] | None):
        self.tokens: set[int] = set()
        self.constant: set[int] = set()  # on every page exactly as often as the page itself: once
        waiting = list(classes or ())
        for c in waiting:
            if any(t["token"] == ROOT for t in c):
                self.constant = {t["token"] for t in c}
                self.tokens |= self.constant
        grown = True
        while grown:
            grown = False
            for c in waiting:
                own = {t["token"] for t in c}
                if not own <= self.tokens and all(t["parent"] in self.tokens or t["parent"] in own for t in c):
                    self.tokens |= own
                    grown = True


def extract_text(page: str, parser: Parser, template: Template, constant_text: bool) -> str:
    """Text of the slots that a template leaves for the article.

    Template elements cut a page into slots. Slots under menus, heads, feet, side bars, notices, adverts,
    forms and comments are furniture. Of the others those inside an ``article`` count, else inside
    ``main``, else inside an element named as content, else all. Text that is the template's own (a
    block of a nested class, on most pages of the host, equally often on each or not) is dropped if
    ``constant_text``; inside an article or main only if it stands once on every page, as several pages may
    hold one article.

    Names are hints. An article or main inside furniture by name is the page's own where no other is; beside
    text of an element named as content or ``main``, or if the name says nothing else, only if it is longer.
    Where names and template leave no text, the slots that only a name makes furniture count, page heads last.
    """
    slots: dict[int, list[tuple[int, str]]] = {}
    for token, _, text, role, content in parser.walk(page):
        if text is not None and not (constant_text and token in (template.constant if content >= 2 else template.tokens)):
            slots.setdefault(role, []).append((content, text))

    def best(*roles: int) -> tuple[int, list[str]]:
        found = [(content, text) for role in roles for content, text in slots.get(role, ())]
        most = max((content for content, _ in found), default=-1)
        return most, [text for content, text in found if content == most]

    rank, texts = best(KEEP)
    for role in (LIFT, LIFT_PLAIN):
        lifted, held = best(role)
        longer = sum(map(len, held)) > sum(map(len, texts))
        if lifted > rank and (longer or role == LIFT and rank < 1):
            rank, texts = lifted, held
    for role in (NAMED, PLAIN, INNER, HEAD):
        if not texts:
            texts = best(role)[1]
    return "\n".join(texts)


def extract_pages(pages: DataFrame, template_pages: int = 10) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``.

    ``n_chars`` counts code points. Null and empty pages and pages without text give an empty text; a null
    url belongs to the host with the empty name. Text that a host repeats on at least half of its
    different pages (on all of them
    once, inside an article or main) is dropped only where the host has ``template_pages`` different pages at least. Repeated rows give repeated
    results; extra columns are ignored. The whole page is read, whatever its length.

    Templates meet the pages in a join by host, which Spark broadcasts while the templates are small and
    else splits by skew, so a host with most pages is many tasks.
    """
    hosted = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    digest = F.xxhash64("html").alias("digest")
    kinds = stored(hosted.select("host", digest).groupBy("host", "digest").agg(F.count("*").alias("copies")))
    different = kinds.groupBy("host").agg(F.count("*").alias("different"))
    copied = stored(kinds.where("copies > 1"))
    counted = hosted.select("host", "html", digest).join(copied, ["host", "digest"], "left").select("host", "html", "copies")
    templates = stored(host_templates(counted).join(different, "host"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        known: dict[str, Template] = {}
        for batch in batches:
            texts = []
            hosts = batch.column("host").to_pylist()
            for row, value in enumerate(batch.column("html")):
                template = known.get(hosts[row])
                if template is None:
                    if len(known) > 1000:
                        known.clear()
                    template = known[hosts[row]] = Template(batch.column("classes")[row].as_py())
                texts.append(extract_text(value.as_py() or "", parser, template, (batch.column("different")[row].as_py() or 0) >= template_pages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return hosted.join(templates, "host", "left").select("page_id", "url", "html", "host", "classes", "different").mapInArrow(
        extract, "page_id bigint, url string, text string, n_chars bigint"
    )
