import hashlib
import random

import numpy as np
from fixtures import EDGE, docs, prose

from tomewright.llm import repeated_strings as R


def by_hand(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        starts = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def result(df, length):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove_repeats(df, length=length).collect())


def expected(rows, length):
    return sorted((str(i), *x) for (i, _), x in zip(rows, by_hand([t for _, t in rows], length)))


def mixtures(seed, count):
    rng = random.Random(seed)
    pool = [prose(k, rng.randint(3, 40)) for k in range(12)] + ["ha " * 60, "ab" * 70, "x" * 150, "é" * 90, "0123456789" * 12]
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, 7)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], prose(rng.randint(0, 10**6), rng.randint(1, 25))]))
        yield rng.choice(["", " ", "\n"]).join(parts)


def test_equals_brute_force(spark):
    rows = list(enumerate([*mixtures(1, 120), *mixtures(2, 10), *mixtures(2, 10), None, "", "short"]))
    for length in (64, 200):
        assert result(docs(spark, rows), length) == expected(rows, length)


def test_blocks_of_a_hot_anchor(spark, monkeypatch):
    """One passage in many different surroundings, in blocks and shards of a few rows."""
    line = prose(5, 30)
    rows = [(k, prose(1000 + k, k % 9 + 1) + line + prose(2000 + k, k % 7 + 1)) for k in range(90)]
    monkeypatch.setattr(R, "_shard_merge", lambda length, _, f=R._shard_merge: f(length, 5))
    spans = R.repeated_spans(docs(spark, rows), length=90, block_rows=8).collect()
    got = {k: np.zeros(len(t.encode()), bool) for k, t in rows}
    place = {R.text_id(t.encode()): k for k, t in rows}
    for s in spans:
        got[place[s.tid]][s.lo : s.hi] = True
    for (k, _), want in zip(rows, by_hand([t for _, t in rows], 90)):
        assert got[k].sum() == want[1]


def test_merged_order_is_the_sorted_order():
    rng = random.Random(8)
    data = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 90))).encode() for _ in range(200)]
    data += [d[:70] + b"zz" for d in data[:40]]
    offset = np.array([rng.randint(0, 20) for _ in data])
    group = np.array([k % 3 for k in range(len(data))])
    shards = [R.Shard(group[a : a + 37], data[a : a + 37], offset[a : a + 37], 64) for a in range(0, len(data), 37)]
    order, bound = R.merged_order(shards)
    behind = [(group[k], data[k][offset[k] : offset[k] + 64].ljust(64, b"\0")) for k in range(len(data))]
    assert [behind[k] for k in order] == sorted(behind)
    for p in range(1, len(order)):
        (g, a), (h, b) = behind[order[p - 1]], behind[order[p]]
        common = next((k for k in range(64) if a[k] != b[k]), 64) if g == h else 0
        assert bound[p] == common


def test_anchor_follows_from_content():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 400).astype(np.uint8).tobytes()
    inside = base[100:300]
    for text in (base, b"q" * 77 + inside, inside + b"tail" * 20_000):
        at = text.index(inside)
        anchor, first, number, offset = R.segments(text, 200)
        k = np.searchsorted(first, at, "right") - 1
        found = (anchor[k], first[k] + offset[k] - at)
        assert first[k] <= at < first[k] + number[k]
        assert found == (R.segments(inside, 200)[0][0], R.segments(inside, 200)[3][0])


def test_edges(spark):
    rows = [*EDGE, (30, prose(3, 40)), (None, "n" * 500)]
    for extra in (False, True):
        assert result(docs(spark, rows, extra), 200) == expected(rows, 200)
    assert R.remove_repeats(docs(spark, [])).count() == 0
    got = R.remove_repeats(docs(spark, [(1, "k" * 201)]), with_spans=True).first()
    assert [(s.lo, s.hi) for s in got.spans] == [(0, 201)]
