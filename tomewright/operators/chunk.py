"""Sentence-packing chunkers: one document in, overlapping chunks out; built-in expressions, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.arrays import scan
from tomewright.functions.strings import SPACE_CLASS, once, py_strip, word_count

# Words per chunk and sentences carried over, for documents and for conversations.
MAX_WORDS = 400
CARRY_DOCUMENT = 3
CARRY_CONVERSATION = 2


def spans(sizes: Column, max_words: int, carry: int) -> Column:
    """Half-open sentence ranges (lo, hi) over an array of word counts; none for an empty one.

    A range closes before the sentence that would overfill it; the next one reaches back ``carry`` sentences,
    yet never before the start of the range it follows. One scan: its state holds the open range, its words
    and the last ``carry`` counts.
    """

    def full(s: Column, x: Column) -> Column:
        return (s["i"] > s["lo"]) & (s["words"] + x > max_words)

    def state(s: Column, x: Column) -> Column:
        back = F.least(s["i"] - s["lo"], F.lit(carry)).cast("int")
        carried = F.aggregate(F.slice(s["recent"], F.lit(carry + 1) - back, back), F.lit(0).cast("long"), lambda t, n: t + n)
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(full(s, x), s["i"] - back).otherwise(s["lo"]).alias("lo"),
            (F.when(full(s, x), carried).otherwise(s["words"]) + x).alias("words"),
            F.slice(F.concat(s["recent"], F.array(x)), 2, carry).alias("recent"),
        )

    def closed(s: Column, x: Column) -> Column:
        return F.struct(s["lo"].alias("lo"), F.when((x < 0) | full(s, x), s["i"]).otherwise(F.lit(-1).cast("long")).alias("hi"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("i"), zero.alias("lo"), zero.alias("words"), F.array_repeat(zero, carry).alias("recent"))
    none = F.slice(F.array(F.struct(zero.alias("lo"), zero.alias("hi"))), 1, 0)
    # A count below zero behind the last sentence closes the last range.
    ended = F.when(F.size(sizes) > 0, F.concat(F.transform(sizes, lambda n: F.coalesce(n, zero)), F.array(F.lit(-1).cast("long"))))
    return F.coalesce(F.filter(scan(ended, start, none, state, closed), lambda r: r["hi"] >= 0), none)


def _chunk(df: DataFrame, text_col: str, sentences: Column, join, max_words: int, carry: int) -> DataFrame:
    others = [c for c in df.columns if c != text_col]
    cut = df.select(*others, once(sentences).alias("__sents"))
    sized = cut.select(*others, "__sents", once(F.transform("__sents", word_count)).alias("__sizes"))
    ranged = sized.select(*others, "__sents", "__sizes", F.posexplode(spans(F.col("__sizes"), max_words, carry)).alias("__no", "__r"))
    lo, n = F.col("__r.lo"), F.col("__r.hi") - F.col("__r.lo")

    def within(c: str) -> Column:
        return F.slice(c, (lo + 1).cast("int"), n.cast("int"))

    return ranged.select(
        *others, F.col("__no").cast("long").alias("chunk_id"), lo.alias("first_sentence"), n.alias("n_sentences"),
        F.aggregate(within("__sizes"), F.lit(0).cast("long"), lambda t, x: t + x).alias("n_words"),
        join(within("__sents")).alias("text"),
    )


def chunk_documents(df: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, carry: int = CARRY_DOCUMENT) -> DataFrame:
    """Sentences end at ``". "``; a chunk is its sentences joined the same way plus a final period."""
    return _chunk(df, text_col, F.split(text_col, "\\. "), lambda part: F.concat(F.array_join(part, ". "), F.lit(".")), max_words, carry)


def chunk_conversations(
    df: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, carry: int = CARRY_CONVERSATION
) -> DataFrame:
    """Sentences end at ``.!?`` and white space; every chunk starts with where it comes from.

    Needs the columns ``year``, ``month`` and ``conv_id``.
    """
    origin = F.format_string("[Conversations, %s %s, %s] ", F.col("year").cast("string"), F.upper("month"), F.col("conv_id").cast("string"))
    stripped = F.transform(F.split(text_col, f"(?<=[.!?])[{SPACE_CLASS}]+"), py_strip)
    sentences = F.filter(stripped, lambda s: s != "")
    return _chunk(df, text_col, sentences, lambda part: F.array_join(part, " "), max_words, carry).withColumn("text", F.concat(origin, "text"))
