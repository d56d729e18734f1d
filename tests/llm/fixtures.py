"""Small inputs shared by the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns an operator adds itself: their presence in the input must not matter.
CLASHING = ("score", "key", "tid", "block", "component", "spans", "template", "slots", "node", "bigram", "words", "n", "size", "seg")


def docs(spark, rows, extra=False):
    """(doc_id, text) rows as documents; ``extra`` adds columns with clashing names."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)))
    return df


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "ber", "ti", "on", "sch", "ou", "ler", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


EDGE = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (None, "no id " + prose(1, 30)),
    (5, prose(2, 20_000)),
    (6, "x" * 100_000),
    (7, prose(3, 40)),
    (7, prose(3, 40)),
    (8, "\x00 null byte, line\u2028break, 🙂 emoji " + prose(4, 12)),
]
