"""BPE encoding over a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tomewright.llm.common import small_batches

#: Unicode white space as the vocabulary's own pattern engine sees it (fixed value).
SPACE = r"\t-\r \x85\xa0  -     　"
END = "</w>"

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else free))
        free += b not in shown
    return letters


class WordBpe:
    """Encoder of one vocabulary whose words end in ``</w>``.

    The last token of the encoding of a prefix follows from shorter prefixes: it is the one token that
    ends the prefix and may stand behind the last token of what is left. So words are put in a trie, and
    each node's state (its last token) is worked out once for all words that share the prefix. Encodings
    of words are kept between calls; the store is emptied beyond ``keep`` words, which bounds memory and
    changes no result.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a BPE vocabulary with word ends and without decoder is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.letters = byte_letters()
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.keep = keep
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Fixed value: the pattern that cuts words, with white space written out.
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE of a short list of symbols: join the leftmost pair of lowest rank until none is left."""
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        parts = list(body)
        if body != token:
            parts[-1] += END
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether BPE leaves two neighbouring tokens as they are; an empty ``left`` is the word's start."""
        if len(self.fits) > 300_000:
            self.fits.clear()
        parts = (self.symbols(left) if left else []) + self.symbols(right)
        known = self.fits[left, right] = self.merged(parts) == ([left, right] if left else [right])
        return known

    def last_token(self, prefix: str, states: list[str], end: str) -> str:
        """The token that ends the encoding of ``prefix`` (``states[i]``: the one that ends its first i letters)."""
        n, vocab, fits = len(prefix), self.vocab, self.fits
        for start in range(max(0, n - self.longest), n):
            token = prefix[start:] + end
            if token in vocab:
                left = states[start]
                known = fits.get((left, token))
                if known or known is None and self.may_follow(left, token):
                    return token
        raise ValueError(f"no encoding of {prefix!r}")

    def learn(self, words: list[str]) -> None:
        """Encode words by depth-first traversal of their trie.

        Sorted words are the trie in depth-first order, so the trie needs no nodes in memory: the stack
        ``states`` holds the states along the path to the current word, and a word adds only those
        behind the prefix it shares with the one before.
        """
        letters = self.letters
        spelt = sorted((w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8")]), w) for w in words)
        states, before = [""], ""
        for path, word in spelt:
            shared = 0
            for a, b in zip(path, before):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            for depth in range(shared + 1, len(path)):
                states.append(self.last_token(path[:depth], states, ""))
            self.words[word] = self.spelled(path, states)
            if len(states) <= len(path):
                states.append(self.last_token(path, states, ""))
            before = path

    def spelled(self, word: str, states: list[str]) -> tuple[bytes, str]:
        """Ids and joined tokens of a word, read backwards from its last token along the states."""
        token = self.last_token(word, states, END)
        tokens, at = [token], len(word) - len(token.removesuffix(END))
        while at:
            tokens.append(states[at])
            at -= len(states[at])
        tokens.reverse()
        return b"".join([self.id_bytes[t] for t in tokens]), " ".join(tokens)

    def cut_words(self, text: str) -> list[str]:
        """Words in order; special tokens of the vocabulary stay whole and are marked by a leading NUL pair."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.cut.findall(self.normal(text))
        words = []
        for k, piece in enumerate(self.split_special.split(text)):
            words += ["\0\0" + piece] if k % 2 else self.cut.findall(self.normal(piece))
        return words

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letters are lowered one by one: no special form at the end of a word
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text; tries are built over some megabytes."""
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (not lists or size + len(texts[at]) <= 4 << 20):
                lists.append(self.cut_words(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.words) > self.keep:
                self.words.clear()
            wanted = set().union(*lists) - self.words.keys()
            for word in [w for w in wanted if w.startswith("\0\0") and w[2:] in self.special]:
                wanted.discard(word)
                self.words[word] = (self.special[word[2:]].to_bytes(4, "little"), word[2:])
            self.learn(list(wanted))
            for words in lists:
                ids, tokens = zip(*map(self.words.__getitem__, words)) if words else ((), ())
                yield b"".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text and digests of ids and decoded text, one row per row of ``docs``.

    ``vocabulary`` is a path every executor can open. A null text counts as empty: no tokens, and the
    digests of nothing. ``with_ids`` adds ``ids array<int>``. Repeated rows give
    repeated results; other columns are ignored. Nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha, every = [], [], [], []
            texts = [v or "" for v in batch.column(1).to_pylist()]
            for ids, back in bpe.encode(texts):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    every.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array([0, *accumulate(n)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(every))])))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs.select("doc_id", text)).mapInArrow(encode, SCHEMA + (", ids array<int>" if with_ids else ""))
