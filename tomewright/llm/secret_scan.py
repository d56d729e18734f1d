"""Secret scan: fixed credential patterns plus sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tomewright.llm.common import small_batches

# The credential patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

#: Candidate strings of the entropy method: unbroken runs of characters that keys and tokens are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Runs that are never secrets: words, numbers with separators, dates, identifiers in UUID form, paths of words.
ALLOWED = (
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]*)*"),
    re.compile(r"[0-9]+(?:[-_/=+][0-9]*)*"),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"[-_=+/]*(.)\1*[-_=+/]*"),
)
HEX_CLASS = frozenset("0123456789abcdefABCDEF")

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "starts array<int>, ends array<int>, kinds array<string>"
)


def window_entropy_spans(run: str, window: int, hex_bits: float, mixed_bits: float) -> list[tuple[int, int, str]]:
    """Maximal stretches of ``run`` covered by windows whose entropy reaches the bound of their class.

    A window holding hexadecimal digits only is held against ``hex_bits``, any other against
    ``mixed_bits``. The counts and the sum of ``n log2 n`` change by one character in and one out, so a
    run of n characters costs n steps whatever the window.
    """
    if len(run) < window:
        return []
    nlog = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, outside, found = 0.0, 0, []
    log_w = math.log2(window)
    for i, ch in enumerate(run):
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        total += nlog[n + 1] - nlog[n]
        outside += ch not in HEX_CLASS
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += nlog[n - 1] - nlog[n]
            outside -= old not in HEX_CLASS
        if i >= window - 1:
            kind, bound = ("entropy_mixed", mixed_bits) if outside else ("entropy_hex", hex_bits)
            if log_w - total / window >= bound - 1e-9:
                start = i - window + 1
                if found and found[-1][2] == kind and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1, kind)
                else:
                    found.append((start, i + 1, kind))
    return found


def _base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that are long enough."""
    spans = []
    low = text.lower()  # cheap test; the patterns decide
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _entropy_spans(text: str, window: int, hex_bits: float, mixed_bits: float) -> list[tuple[int, int, int]]:
    spans = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(p.fullmatch(run) for p in ALLOWED):
            continue
        for start, end, kind in window_entropy_spans(run, window, hex_bits, mixed_bits):
            if not any(p.fullmatch(run, start, end) for p in ALLOWED):
                spans.append((m.start() + start, KINDS.index(kind), m.start() + end))
    return spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(
    docs: DataFrame, text: str = "text", window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.6
) -> DataFrame:
    """One row per row of ``docs`` with the secrets found in its whole text; no shuffle.

    Base kinds are leftmost, non-overlapping matches of their pattern; matches that are too short are
    dropped. Entropy kinds come from :func:`window_entropy_spans` over candidate strings that no
    allow-list pattern covers; the allow-list never suppresses a base match. Positions are code points,
    ends exclusive. A null text counts as empty and gives zero counts and empty strings. Repeated rows
    give repeated results; other columns of ``docs`` are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("na", "nc", "nh", "sha", "spans", "starts", "ends", "kinds")}
            for value in batch.column(1):
                t = value.as_py() or ""
                base = _base_spans(t)
                every = sorted(base + _entropy_spans(t, window, hex_bits, mixed_bits))
                for key, kind in (("na", 0), ("nc", 1), ("nh", 2)):
                    out[key].append(sum(k == kind for _, k, _ in base))
                out["sha"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(every))
                out["starts"].append([s for s, _, _ in every])
                out["ends"].append([e for _, _, e in every])
                out["kinds"].append([KINDS[k] for _, k, _ in every])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(out[k], pa.int64()) for k in ("na", "nc", "nh")),
                    *(pa.array(out[k], pa.string()) for k in ("sha", "spans")),
                    *(pa.array(out[k], pa.list_(pa.int32())) for k in ("starts", "ends")),
                    pa.array(out["kinds"], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "starts", "ends", "kinds"],
            )

    return small_batches(docs.select("doc_id", text)).mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """``docs`` with every stretch covered by found spans replaced by ``mark``; other columns unchanged.

    Overlapping and touching spans become one mark. A null text stays null; a text without a secret is
    returned as it is. Replacing happens row by row beside the scan, so that no text is shuffled.
    """
    window, hex_bits, mixed_bits = how.get("window", 20), how.get("hex_bits", 3.0), how.get("mixed_bits", 3.6)
    place = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        spans = sorted((s, e) for s, _, e in _base_spans(t) + _entropy_spans(t, window, hex_bits, mixed_bits))
        if not spans:
            return t
        parts, at, until = [], 0, -1
        for s, e in spans:
            if s > until:
                if until >= 0:
                    at = until
                parts += [t[at:s], mark]
            until = max(until, e)
        return "".join(parts) + t[until:]

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([clean(v.as_py()) for v in batch.column(place)], batch.column(place).type)
            yield batch.set_column(place, batch.schema.field(place), new)

    return small_batches(docs).mapInArrow(redact, docs.schema)
