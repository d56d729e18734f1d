"""Hooks for the two external services: batch embedder and answer generator, with local stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions.strings import MIN_SPOKEN_WORDS, head_words

# Texts per call, tries per call, words and characters sent per text.
BATCH, TRIES, MAX_INPUT_WORDS, MAX_INPUT_CHARS = 50, 3, 3000, 6000

EmbedFn = Callable[[list[str]], list]


def hashed_words(dim: int = 64) -> EmbedFn:
    """Deterministic stand-in for an embedding service: unit-length counts of hashed words."""

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            slots = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in t.lower().split()]
            v = np.bincount(slots, minlength=dim).astype(np.float32)
            n = np.linalg.norm(v)
            out.append(v / n if n > 0 else v)
        return out

    return embed


def with_retries(call: Callable, arg, tries: int = TRIES, pause: float = 1.0):
    """Call up to ``tries`` times, waiting 1, 2, 4 ... times ``pause`` between; the last error rises."""
    for attempt in range(tries):
        try:
            return call(arg)
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)


def embed_texts(
    df: DataFrame, text_col: str, embed_fn: EmbedFn | None = None, *, out: str = "embedding", batch: int = BATCH,
    tries: int = TRIES, pause: float = 1.0, max_words: int | None = None, max_chars: int | None = None,
) -> DataFrame:
    """Add a vector per text, calling ``embed_fn`` with up to ``batch`` texts inside the tasks.

    Whole texts are sent. ``max_words`` or ``max_chars`` cut what is sent where a service has an input limit
    (``MAX_INPUT_WORDS`` for one); the text column stays as it is.
    """
    fn = embed_fn or hashed_words()
    sent: Column = F.col(text_col)
    if max_words:
        sent = head_words(sent, max_words)
    if max_chars:
        sent = F.substring(sent, 1, max_chars)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list = []
            for lo in range(0, len(texts), batch):
                got.extend(with_retries(fn, texts.iloc[lo : lo + batch].tolist(), tries, pause))
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, vectors(sent))


def leading_passage(prompt: str) -> str:
    """Deterministic stand-in for an answer service: the first passage of the context."""
    return prompt.split("\n\n---\n\n")[0].split("[Passage 2]")[0].strip()


def generate_answers(
    contexts: DataFrame, generate_fn: Callable[[str], str] = leading_passage, *, concise: bool = False,
    retry_note: str = "Write more.", min_words: int = MIN_SPOKEN_WORDS,
) -> DataFrame:
    """Add ``answer``; a concise answer below ``min_words`` words is asked for once more."""

    def answer(prompt: str) -> str:
        text = generate_fn(prompt)
        if concise and len(text.split()) < min_words:
            text = generate_fn(f"{prompt}\n\n{retry_note}")
        return text

    @F.pandas_udf(T.StringType())
    def answers(prompts: pd.Series) -> pd.Series:
        return prompts.map(answer)

    return contexts.withColumn("answer", answers("context"))
