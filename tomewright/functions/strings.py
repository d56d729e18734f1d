"""Column expressions for string rules that follow Python (not SQL) conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() and str.split() treat as white space.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Character price and speech-rate constants.
CHARS_PER_TOKEN = 4
EMBED_USD_PER_1M = 0.12
WORDS_PER_MINUTE = 120.0
MIN_SPOKEN_WORDS = 340


def once(c: Column) -> Column:
    """Select this instead of a costly column that a later filter tests.

    Filters are pushed below projections and would work the column out a second time; they are not
    pushed below a generator.
    """
    return F.explode(F.array(c))


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_SPACE))


def norm_key(c: Column) -> Column:
    """Lookup key of a question: strip, then lower-case."""
    return F.lower(py_strip(c))


def sqlite_key(c: Column) -> Column:
    """``LOWER(TRIM(x))`` of an embedded SQL store: trims blanks only, folds ASCII letters only."""
    return F.translate(
        F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def md5_key(c: Column) -> Column:
    return F.md5(norm_key(c).cast("binary"))


def _unicode_spaces(c: Column) -> Column:
    """Python also splits at four control separators that Unicode does not count as white space."""
    return replace_in_order(c, [(ch, " ") for ch in "\x1c\x1d\x1e\x1f"])


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(_unicode_spaces(c), F.lit(r"(?U)\S+")).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(_unicode_spaces(c), r"(?U)\s+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def embed_cost(tokens: Column, usd_per_1m: float = EMBED_USD_PER_1M) -> Column:
    return tokens / F.lit(1_000_000.0) * F.lit(usd_per_1m)


def spoken_minutes(n_words: Column) -> Column:
    return n_words / F.lit(WORDS_PER_MINUTE)


def head_words(c: Column, limit: int, mark: str = "...") -> Column:
    """Whole text while within ``limit`` words, else that many words re-joined by one space."""
    return F.when(
        word_count(c) > limit, F.concat(F.array_join(F.slice(words(c), 1, limit), " "), F.lit(mark))
    ).otherwise(c)


def head_chars(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def title_case(c: Column) -> Column:
    """Python ``str.title``: every run of letters starts upper-case (also after ' and -)."""
    runs = F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def replace_in_order(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements applied one after the other; later pairs see earlier results."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def reject_reason(question: Column, top_k: Column, *, max_chars: int, max_k: int, strip_first: bool) -> Column:
    """``ok`` or why a request is refused. ``strip_first`` tells whether length counts outer blanks."""
    sized = py_strip(question) if strip_first else question
    return (
        F.when(question.isNull() | (py_strip(question) == ""), "empty")
        .when(F.length(sized) > max_chars, "too_long")
        .when((top_k < 1) | (top_k > max_k), "bad_top_k")
        .otherwise("ok")
    )


# Fixed value: accepted e-mail shape.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)
