"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import small_batches

WORDS, SHAPES = 960, 63
TERMS = WORDS + SHAPES + 1  # the last term counts words that repeat the one before
SCHEMA = "doc_id bigint, score double"


class TermCodes(dict):
    """Raw word -> ``hashed word * 64 + shape``; emptied when it grows beyond a bound, which changes no result."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = raw.strip("\"'`.,;:!?()[]{}<>|*%$&#@~^_=+-/\\")
        if not core:
            case = 0
        elif core.islower():
            case = 1
        elif core.isupper():
            case = 2 if len(core) > 1 else 3
        elif core.istitle():
            case = 3
        elif core.isnumeric():
            case = 4
        elif core.isalpha():
            case = 5
        else:
            case = 6
        tail = raw[raw.rfind(core) + len(core) :] if core else raw
        marks = 0 if not tail else 1 if tail in (",", ".", ";", ":") else 2 + zlib.crc32(tail[:1].encode()) % 7
        word = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % WORDS
        code = self[raw] = word * 64 + case * 9 + marks
        return code


def term_counts(texts: list[str], codes: TermCodes) -> np.ndarray:
    """Counts of the hashed terms in each whole text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        c = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        out[row, :WORDS] = np.bincount(c >> 6, minlength=WORDS)
        out[row, WORDS : WORDS + SHAPES] = np.bincount(c & 63, minlength=SHAPES)[:SHAPES]
        out[row, -1] = np.count_nonzero(c[1:] == c[:-1])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class NeighbourModel:
    """Latent vectors of labelled documents and the projection that made them."""

    weights: np.ndarray  # of terms
    projection: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    prior: float
    k: int
    power: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.weights) @ self.projection)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """Probability of label 1: votes of the ``k`` nearest, each weighted by its cosine to the ``power``.

        All labelled vectors are compared with every document, a block of documents at a time. A text
        without a term has no neighbour and gets the share of label 1.
        """
        out = np.full(len(counts), self.prior)
        for at in range(0, len(counts) if len(self.labels) else 0, block):
            part = counts[at : at + block]
            cosine = self.latent(part) @ self.vectors.T
            k = min(self.k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** self.power
            total = weight.sum(1)
            votes = (weight * self.labels[near]).sum(1)
            # One vote of the prior keeps scores inside (0, 1) and settles texts without near neighbours.
            mixed = (votes + self.prior) / (total + 1.0)
            out[at : at + block] = np.where(part[:, :-1].sum(1) > 0, mixed, self.prior)
        return np.clip(out, 0.0, 1.0)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of term shares, words and shapes each scaled to a share of their own."""
    total = np.maximum(counts[:, WORDS : WORDS + SHAPES].sum(1, keepdims=True), 1.0)
    x = np.sqrt(counts / total) * weights
    x[:, :WORDS] = 0.35 * _unit(x[:, :WORDS])
    x[:, WORDS : WORDS + SHAPES] = _unit(x[:, WORDS : WORDS + SHAPES])
    return x


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = 48, k: int = 31, power: float = 4.0) -> NeighbourModel:
    """Latent-semantic space by eigenvectors of the weighted term matrix; term weights fall with document frequency."""
    n = len(labels)
    if n == 0:
        return NeighbourModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, k, power)
    seen = (counts > 0).sum(0)
    weights = np.log((1 + n) / (1 + seen)).astype(np.float32) + 0.3
    weights[-1] = 1.0
    x = _weighted(counts, weights)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = np.ascontiguousarray(axes[:, ::-1][:, :dims], np.float32)
    model = NeighbourModel(weights, projection, np.zeros((0, dims), np.float32), labels.astype(np.float64), float(labels.mean()), k, power)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows no label is ever learnt from: crc32 of the id as text leaves remainder 0 by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = TermCodes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts = term_counts([v or "" for v in part.column(1).to_pylist()], codes)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([c.tobytes() for c in counts], pa.binary())], names=["label", "counts"]
            )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4096, **how) -> NeighbourModel:
    """Fit on at most ``sample`` labelled rows that are not held out, taken in order of a hash of their id.

    The sample bounds what reaches the driver (``sample`` rows of ``TERMS`` counts) and what is later
    broadcast. Ids with several labels count once with the larger; null ids and labels are ignored.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` small rows, whatever the size of the input: safe to broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("label", "text")
    got = small_batches(rows).mapInArrow(_counted, "label int, counts binary").toArrow()
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.float32).reshape(-1, TERMS)
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*counts.T[:8], y))  # independent of the order in which tasks answer
    return fit(counts[order], (y[order] > 0).astype(np.float64), **how)


def _scored(docs: DataFrame, model: NeighbourModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array, codes: TermCodes) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 512):
            out.append(shared.value.score(term_counts([v or "" for v in texts.slice(at, 512).to_pylist()], codes)))
        return np.concatenate(out) if out else np.zeros(0)

    return scores


def score_documents(docs: DataFrame, model: NeighbourModel, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; only the text is looked at, and all of it.

    A null text counts as empty. Repeated rows give repeated results, other columns are ignored; nothing
    is shuffled. The model holds a bounded sample, so what is broadcast does not grow with the corpus.
    """
    scores = _scored(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = TermCodes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), codes))], names=["doc_id", "score"])

    return small_batches(docs.select("doc_id", text)).mapInArrow(score, SCHEMA)


def keep_quality(docs: DataFrame, model: NeighbourModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score reaches ``threshold``, unchanged."""
    scores, place = _scored(docs, model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = TermCodes()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place), codes) >= threshold))

    return small_batches(docs).mapInArrow(keep, docs.schema)
