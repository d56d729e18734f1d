"""Row-local text rules: cleaning, slicing, normalising, classifying. None of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import fixed_values as fixed
from tomewright.functions.strings import SPACE_CLASS, once, py_strip, replace_in_order, words

#: Private-use characters that rules put into a text while they work, and stand-ins for those it holds itself.
MARK, PLAIN = "\ue000", "\ue001"
_OWN = [("\ue002", "\ue002\ue003"), (MARK, "\ue002\ue004"), (PLAIN, "\ue002\ue005")]


def guarded(text: Column) -> Column:
    """``text`` without the marks, reversibly."""
    for mark, form in _OWN:
        text = F.replace(text, F.lit(mark), F.lit(form))
    return text


def unguarded(text: Column) -> Column:
    for mark, form in reversed(_OWN):
        text = F.replace(text, F.lit(form), F.lit(mark))
    return text


def java_literal(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}#\-])", r"\\\1", s)


# -- cleaning ----------------------------------------------------------------------------------------


def drop_lines(text: Column, markers: list[str]) -> Column:
    """Drop every line that contains one of the markers."""

    def clean(line: Column) -> Column:
        hit = F.lit(False)
        for m in markers:
            hit = hit | line.contains(m)
        return ~hit

    return F.array_join(F.filter(F.split(text, "\n"), clean), "\n")


def squeeze_blank_lines(text: Column) -> Column:
    return py_strip(F.regexp_replace(text, "\n\n\n+", "\n\n"))


def clean_text(text: Column, markers: list[str] = fixed.PAGE_MARKERS_B) -> Column:
    return squeeze_blank_lines(drop_lines(text, markers))


def keep_first_prefixed_line(text: Column, prefixes: list[str]) -> Column:
    """Of all lines with one of the prefixes only the first stays."""
    line = "\n(?:" + "|".join(java_literal(p) for p in prefixes) + ")[^\n]*"
    whole = F.concat(F.lit("\n"), text)
    first = F.regexp_extract(whole, line, 0)
    cut = F.instr(whole, first) + F.length(first)
    kept = F.concat(F.substring(whole, F.lit(1), cut - 1), F.regexp_replace(F.substring(whole, cut, F.length(whole)), line, ""))
    return F.when(first == "", text).otherwise(F.substring(kept, F.lit(2), F.length(kept)))


def section_slice(text: Column, start: str, end: str) -> Column:
    """From the first ``start`` to the first ``end`` anywhere; whole text without ``start``.

    An ``end`` that lies before ``start`` gives an empty slice.
    """
    a, b = F.instr(text, start), F.instr(text, end)
    stop = F.when(b == 0, F.length(text) + 1).otherwise(b)
    return F.when(a == 0, text).otherwise(F.substring(text, a, F.greatest(stop - a, F.lit(0))))


# -- month files -> conversation blocks ---------------------------------------------------------------


def conversation_blocks(
    files: DataFrame,
    *,
    header: str = fixed.CONVERSATION_ID,
    skip_prefixes: list[str] = fixed.FILE_HEADER_PREFIXES,
    skip_patterns: list[str] = (),
    min_chars: int = 100,
    keep: list[str] = (),
) -> DataFrame:
    """Cut each file ``(year, month, text)`` at its id lines: ``(block, conv_id, title, body)``.

    Text before the first id line belongs to ``<year>_<month>_main``. A title is made of the non-blank
    lines among the four after the id line. Blocks of ``min_chars`` or fewer are dropped. The whole cut
    is one regex split inside the row.
    """
    sp = f"[{SPACE_CLASS}&&[^\n]]*"
    head = f"(?md)^{sp}({header}){sp}$"
    titled = f"{head}(?=(?:\n([^\n]*(?:\n[^\n]*){{0,3}}))?)"
    text = F.col("text")
    main_id = F.concat_ws("_", F.col("year").cast("string"), F.col("month"), F.lit("main"))
    ids = F.concat(F.array(main_id), F.regexp_extract_all(text, F.lit(head), F.lit(1)))
    titles = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(titled), F.lit(2)))
    cut = files.select(
        *keep, "year", "month",
        F.posexplode(F.arrays_zip(ids.alias("id"), titles.alias("title"), F.split(text, head).alias("body"))).alias("block", "b"),
        F.size(ids).alias("n_blocks"),
    )

    def wanted(line: Column) -> Column:
        ok = line != ""
        for p in [*skip_prefixes, *skip_patterns]:
            ok = ok & ~line.startswith(p)
        return ok

    def lines(c: Column) -> Column:
        return F.transform(F.split(c, "\n"), py_strip)

    title_lines = F.filter(lines(F.col("b.title")), lambda t: (t != "") & ~t.isin(*fixed.TITLE_DASHES))
    title = F.array_join(F.transform(title_lines, lambda t: F.concat(t, F.lit(" "))), "")
    return (
        cut.select(
            *keep, "year", "month",
            F.col("block").cast("long").alias("block"),
            F.col("b.id").alias("conv_id"),
            F.when(F.col("block") == F.col("n_blocks") - 1, py_strip(title)).otherwise(title).alias("title"),
            once(F.array_join(F.filter(lines(F.col("b.body")), wanted), "\n")).alias("body"),
        )
        .where(F.length("body") > min_chars)
    )


# -- sentences ----------------------------------------------------------------------------------------


def sentence_rows(df: DataFrame, text_col: str, keep: list[str], paragraph: str = "\n\n") -> DataFrame:
    """``(para, sent, sentence, para_break)``: non-blank sentences of non-blank paragraphs.

    ``para_break`` marks the last sentence of a paragraph that is not the last one of the text.
    """
    paras = F.split(F.col(text_col), java_literal(paragraph) if paragraph.strip() else paragraph)
    base = df.select(*keep, F.size(paras).alias("n"), F.posexplode(paras).alias("para", "p"))
    sents = F.filter(F.split("p", f"(?<=[.!?])[{SPACE_CLASS}]+"), lambda s: py_strip(s) != "")
    rows = base.where(py_strip(F.col("p")) != "").withColumn("s", sents)
    return rows.select(
        *keep, F.col("para").cast("long").alias("para"), "n", F.size("s").alias("m"),
        F.posexplode("s").alias("sent", "sentence"),
    ).select(
        *keep, "para", F.col("sent").cast("long").alias("sent"), "sentence",
        ((F.col("sent") == F.col("m") - 1) & (F.col("para") < F.col("n") - 1)).alias("para_break"),
    )


def sentence_groups(text: Column, size: int = 3) -> Column:
    """Array of paragraphs of ``size`` sentences each; a text without end marks is one paragraph."""
    groups = F.regexp_extract_all(text, F.lit(f"(?:[^.!?]+[.!?]+){{1,{size}}}"), F.lit(0))
    spaced = F.transform(groups, lambda g: py_strip(F.regexp_replace(g, "([.!?])(?=[^.!?])", "$1 ")))
    return F.when(F.size(groups) == 0, F.array(py_strip(text))).otherwise(spaced)


# -- spoken form --------------------------------------------------------------------------------------


def number_words() -> dict[str, str]:
    return {str(n): w for n, w in fixed.NUMBER_WORDS.items()}


def spoken_references(text: Column) -> Column:
    """``BG 2.20`` to ``Bhagavad Geeta, chapter two, verse twenty``, and the like.

    Regexes put codes and numbers between marker characters; one split then swaps each for its words.
    """
    two, three = r"\s+(\d+)\.(\d+)", r"\s+(\d+)\.(\d+)\.(\d+)"

    def said(lead: str, *parts: str) -> str:
        return lead + "".join(f", {part} {MARK}${i}{MARK}" for i, part in enumerate(parts, 2))

    def any_of(names) -> str:
        firsts = "".join(sorted({n[0] for n in names}))
        return f"(?=[{firsts}])\\b({'|'.join(names)})"  # the first letters rule most places out at once

    text = guarded(text)
    code = f"{MARK}$1{MARK}"
    for pattern, by in [
        (rf"(?U){any_of(fixed.SPOKEN_CANTO_BOOKS)}{three}\b", said(code, "canto", "chapter", "verse")),
        (rf"(?U){any_of(fixed.SPOKEN_BOOKS)}{two}\b", said(code, "chapter", "verse")),
        (rf"(?U)({'|'.join(fixed.SPOKEN_NAMES)}),?{two}", said("$1", "chapter", "verse")),
        (rf"(?U)({'|'.join(fixed.SPOKEN_CANTO_NAMES)}),?{three}", said("$1", "canto", "chapter", "verse")),
    ]:
        text = F.regexp_replace(text, pattern, by)
    names = {**number_words(), **fixed.SPOKEN_BOOKS, **fixed.SPOKEN_CANTO_BOOKS}
    spoken = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def plain(piece: Column) -> Column:
        return F.when(piece.startswith("0"), F.regexp_replace(piece, "^0+(?=.)", "")).otherwise(piece)

    def word(piece: Column) -> Column:
        return F.coalesce(F.element_at(spoken, piece), piece)

    pieces = F.transform(F.split(text, MARK), lambda p, i: F.when(i % 2 == 0, p).otherwise(plain(p)))
    return unguarded(F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(word(p))), ""))


#: Terms up to which a dictionary becomes nested calls in the JVM; a larger one is one automaton in Python.
NESTED_TERMS = 64


def replace_terms(text: Column, terms: dict[str, str]) -> Column:
    """Literal term replacement, longest term first, substrings included, results open to later terms.

    A large dictionary is matched by an automaton that finds all terms of a text in one pass. The first of them
    in order is replaced and the text matched again for those after it, so terms that do not occur cost nothing and
    the plan has one node for any number of terms.
    """
    ordered = sorted(((k, v) for k, v in terms.items() if k), key=lambda kv: -len(kv[0]))
    return replace_in_order(text, ordered) if len(ordered) <= NESTED_TERMS else term_automaton(ordered)(text)


def term_automaton(ordered: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """Column function that replaces the terms of a list, one after the other, by an automaton built once a task."""

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n, (term, _) in enumerate(ordered):
            if term not in automaton:
                automaton.add_word(term, n)
        automaton.make_automaton()

        def one(text: str | None) -> str | None:
            after = -1
            while text:
                after = min((n for _, n in automaton.iter(text) if n > after), default=None)
                if after is None:
                    break
                text = text.replace(*ordered[after])
            return text

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return replaced


def transliterate(text: Column, pairs: list[tuple[str, str]] = fixed.TRANSLITERATION) -> Column:
    return replace_in_order(text, pairs)


def voice_clean(text: Column) -> Column:
    """Markdown, brackets, short asides, dashes and semicolons to plain speech punctuation."""
    steps = [
        (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"(?U)#{1,6}\s+", ""), (r"`(.+?)`", "$1"),
        (r"\[([^\]]+)\]", "$1"), (r"\(([^)]{1,80})\)", ", $1,"),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    text = F.replace(F.replace(text, F.lit("—"), F.lit(", ")), F.lit("–"), F.lit(", "))
    text = F.replace(text, F.lit(";"), F.lit("."))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U),\s*,", ","), r"(?U)\s{2,}", " ")
    return py_strip(text)


def preprocess_for_voice(text: Column, terms: dict[str, str], pairs=fixed.TRANSLITERATION) -> Column:
    return voice_clean(transliterate(spoken_references(replace_terms(text, terms)), pairs))


def residual_rows(df: DataFrame, text: Column, keep: list[str], letters: str = fixed.RESIDUE_LETTERS) -> DataFrame:
    """Words that still hold one of the letters: ``(position, word, letters)``."""
    rows = df.select(*keep, F.posexplode(words(text)).alias("position", "word"))
    return rows.where(F.col("word").rlike(f"[{letters}]")).select(
        *keep, F.col("position").cast("long").alias("position"), "word",
        F.array_join(F.regexp_extract_all("word", F.lit(f"[{letters}]"), F.lit(0)), "").alias("letters"),
    )


def missed_terms(residual: DataFrame) -> DataFrame:
    """Different words of ``residual_rows``, how often and in how many texts they occur."""
    return residual.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_rows"))


def share_text(question: Column, answer: Column, signature: str = "", limit: int = 500) -> Column:
    clean = F.regexp_replace(F.regexp_replace(answer, r"(?U)#{1,3}\s", ""), r"\*\*", "")
    clean = py_strip(F.regexp_replace(clean, r"(?Um)^\s*[-•]\s", "• "))
    return F.concat(F.lit("Q: "), question, F.lit("\n\n"), F.substring(clean, 1, limit), F.lit("...\n\n" + signature))


# -- line classification ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    exclusive: list[str] = field(default_factory=lambda: fixed.VERSE_WORDS)
    common: list[str] = field(default_factory=lambda: fixed.SHARED_TERMS)
    function_words: list[str] = field(default_factory=lambda: fixed.ENGLISH_WORDS)
    endings: str = fixed.VERSE_ENDINGS
    letters: str = fixed.VERSE_LETTERS
    mantra: str = fixed.MANTRA
    reference: str = fixed.VERSE_REFERENCE

    def is_term(self, w: Column) -> Column:
        return w.isin(*self.exclusive, *self.common) | w.rlike(self.endings)


def tokenize(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "[.,;:!?\"'()\\[\\]{}—–\\-]", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")


def line_facts(lines: Column, vocab: Vocabulary, quote_sign: bool = True) -> Column:
    """Array of struct(line, probe, n_words, n_exclusive, n_common, n_english, marked) per line.

    ``probe`` is the stripped line, without a leading quote sign. Tokens are made once per line.
    """

    def split_up(line: Column) -> Column:
        trimmed = py_strip(line)
        inner = F.when(trimmed.startswith("> "), py_strip(F.substring(trimmed, 3, 1 << 30))).otherwise(trimmed)
        probe = inner if quote_sign else trimmed
        return F.struct(trimmed.alias("line"), probe.alias("probe"), tokenize(probe).alias("tokens"))

    def count(x: Column) -> Column:
        t = x["tokens"]
        return F.struct(
            x["line"].alias("line"),
            x["probe"].alias("probe"),
            F.size(t).alias("n_words"),
            F.size(F.filter(t, lambda w: w.isin(*vocab.exclusive) | w.rlike(vocab.endings))).alias("n_exclusive"),
            F.size(F.filter(t, lambda w: w.isin(*vocab.common))).alias("n_common"),
            F.size(F.filter(t, lambda w: w.isin(*vocab.function_words))).alias("n_english"),
            x["probe"].rlike(vocab.letters).alias("marked"),
        )

    return F.transform(F.transform(lines, split_up), count)


def is_verse(f: Column) -> Column:
    """Rule cascade over the facts of one line."""
    terms = f["n_exclusive"] + f["n_common"]
    return (
        F.when(F.length(f["probe"]) < 10, False)
        .when(f["marked"], True)
        .when(f["n_words"] == 0, False)
        .when((f["n_english"] >= 3) | ((f["n_english"] >= 2) & (f["n_exclusive"] == 0)), False)
        .when(f["n_exclusive"] >= 2, True)
        .when((f["n_exclusive"] >= 1) & (terms >= 3) & (f["n_words"] <= 12), True)
        .when((f["n_english"] == 0) & (terms >= 3) & (f["n_words"] <= 10), True)
        .when((f["n_english"] == 0) & (f["n_words"] <= 12) & (terms / f["n_words"] > 0.7), True)
        .otherwise(False)
    )


def term_runs(df: DataFrame, text_col: str, keep: list[str], vocab: Vocabulary) -> DataFrame:
    """Runs of adjacent term words holding at least two terms: ``(run, phrase, n_terms)``.

    Each word is tagged as term or plain, and one regex then reads the runs off the tagged text.
    """

    def parts(tok: Column) -> Column:
        bare = F.translate(F.lower(tok), ".,;:!?\"'()[]{} \t\n\r\x0b\x0c\xa0", "")
        return F.struct(tok.alias("tok"), bare.alias("bare"))

    def tag(x: Column) -> Column:
        hit = vocab.is_term(x["bare"]) | x["tok"].rlike(vocab.letters)
        return F.concat(F.when(hit, MARK).otherwise(PLAIN), x["tok"])

    toks = F.split(guarded(F.col(text_col)), r"(?U)(?<=\s)(?=\S)")
    tagged = F.array_join(F.transform(F.transform(toks, parts), tag), "")
    run = f"(?:{MARK}[^{MARK}{PLAIN}]*){{2,}}"
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(tagged, F.lit(run), F.lit(0))).alias("run", "r"))
    phrase = unguarded(F.replace("r", F.lit(MARK), F.lit("")))
    return (
        rows.withColumn("phrase", phrase)
        .withColumn("n_terms", F.size(F.filter(tokenize(F.col("phrase")), vocab.is_term)).cast("long"))
        .where(F.col("n_terms") >= 2)
        .select(*keep, F.col("run").cast("long").alias("run"), "phrase", "n_terms")
    )


# -- ids ----------------------------------------------------------------------------------------------


def citation_label(code: Column, chunk_id: Column, base_name: Column) -> Column:
    """Readable reference from a chunk id such as ``bg_2_47`` and the full name of its work."""
    parts = F.split(chunk_id, "_")
    n = F.size(parts)
    kind = F.lower(code)

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    def rest(i: int, sep: str) -> Column:
        return F.array_join(F.slice(parts, i + 1, F.greatest(n - i, F.lit(0))), sep)

    division = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in fixed.DIVISIONS.items() for x in kv]), part(1)), part(1)
    )
    return (
        F.when(chunk_id.isNull() | (chunk_id == "") | (n < 2), base_name)
        .when((kind == "bg") & (n >= 3), F.concat(base_name, F.lit(", Chapter "), part(1), F.lit(", Verse "), rest(2, ".")))
        .when(
            (kind == "sb") & (n >= 4),
            F.concat(base_name, F.lit(", Canto "), part(1), F.lit(", Chapter "), part(2), F.lit(", Verse "), rest(3, ".")),
        )
        .when(
            (kind == "cc") & (n >= 4),
            F.concat(base_name, F.lit(", "), division, F.lit(", Chapter "), part(2), F.lit(", Text "), rest(3, ".")),
        )
        .when((kind == "letters") & (n >= 2), F.concat(base_name, F.lit(" ("), rest(1, " "), F.lit(")")))
        .otherwise(base_name)
    )


def keyword_score(query: str, keywords: Column, question: Column, sources: Column) -> Column:
    """2 per keyword and 1 per source holding the query text, 3 when the question holds it."""
    q = F.lit(query.lower().strip())

    def hits(c: Column) -> Column:
        return F.size(F.filter(c, lambda x: F.contains(F.lower(x), q)))

    return (hits(keywords) * 2 + F.when(F.contains(F.lower(question), q), 3).otherwise(0) + hits(sources)).cast("long")
