import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import EDGE, docs, prose

from tomewright.llm import periodic_runs as P
from tomewright.llm.catalog import queries


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs_by_hand(w, least=12):
    """Every (start, length, period) by extending equal places word by word."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - at + q
            if length >= max(least, 2 * q):
                found.setdefault((at, length), q)
            at = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed_by_hand(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def planted_by_hand(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected(doc_id, text):
    w = planted_by_hand(doc_id, words_of(text))
    runs = runs_by_hand(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed_by_hand(w, runs)).hexdigest(),
    )


def texts(seed):
    """Random, periodic, nested and Fibonacci-like word sequences of small alphabets."""
    rng = random.Random(seed)
    for _ in range(120):
        n, k = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 5, 30])
        t = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if len(t) > 4:
                a = rng.randrange(len(t) - 2)
                part = t[a : a + rng.randint(1, 20)]
                t[a : a + len(part)] = part * rng.randint(2, 9)
        yield t
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b
    yield [0] * 500
    yield [0, 1, 1] * 100 + [2] + [1, 0] * 60


@pytest.mark.parametrize("seed", range(4))
def test_equals_extension_word_by_word(seed):
    given = list(texts(seed))
    got = P.text_runs([np.array(t, np.int64) for t in given])
    assert [sorted(map(tuple, r.tolist())) for r in got] == [runs_by_hand(t) for t in given]


@pytest.mark.parametrize("words, asked", [(50, 3), (1 << 30, 1 << 30)])
def test_size_of_strings_and_questions_does_not_matter(monkeypatch, words, asked):
    monkeypatch.setattr(P, "STRING_WORDS", words)
    monkeypatch.setattr(P, "ASKED", asked)
    given = list(texts(9))
    got = P.text_runs([np.array(t, np.int64) for t in given])
    assert [sorted(map(tuple, r.tolist())) for r in got] == [runs_by_hand(t) for t in given]


def test_agreement_in_both_directions():
    rng = random.Random(3)
    t = [rng.randrange(2) for _ in range(300)] + [0] * 90 + [0, 1] * 60 + [rng.randrange(2) for _ in range(50)]
    string = np.array([7, *t, 8], np.int64)
    levels = P.recompress(string, 7, 3)
    assert len(levels) > 5 and len(levels[-1].sym) <= 3
    back = [level.mirrored() for level in levels]
    i = np.array([rng.randrange(1, len(t)) for _ in range(4000)])
    j = np.array([rng.randrange(1, len(t)) for _ in range(4000)])
    i, j = i[i != j], j[i != j]
    ahead = lambda s, x, y: next(k for k in range(len(s)) if s[x + k] != s[y + k])
    s, r, n = string.tolist(), string[::-1].tolist(), len(string)
    assert P.agreement(levels, i, j).tolist() == [ahead(s, x, y) for x, y in zip(i.tolist(), j.tolist())]
    assert P.agreement(back, i, j).tolist() == [ahead(r, x, y) for x, y in zip(i.tolist(), j.tolist())]
    assert n == len(r)


def test_a_grammar_stays_small_on_long_runs():
    string = np.array([3, *([0, 1, 1, 2] * 50_000), 4], np.int64)
    levels = P.recompress(string, 3, 3)
    assert sum(len(level.sym) for level in levels) < 6 * len(string)
    assert P.agreement(levels, np.array([1]), np.array([5])).tolist() == [199_996]


@pytest.mark.parametrize("extra", [False, True])
def test_rows_of_the_query(spark, extra):
    rows = [*EDGE, *((100 + k, " ".join(f"w{x}" for x in t)) for k, t in enumerate(texts(1)))]
    rows += [(400 + k, prose(k, 60)) for k in range(60)] + [(9, "a b c\x85 " * 20), (10, "x\x1cy " * 12)]
    got = P.run_digests(P.find_runs(P.with_planted_runs(docs(spark, rows, extra))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(*r)) for r in rows)


def test_texts_and_spans_of_the_operator(spark):
    row = P.find_runs(docs(spark, [(1, "say  it " + "la li\t" * 7 + "end")])).first()
    assert (row.n_words, row.collapsed) == (17, "say it la li end")
    assert [tuple(r) for r in row.runs] == [(2, 14, 2)]


def test_empty_table(spark):
    assert P.run_digests(P.find_runs(P.with_planted_runs(docs(spark, [])))).collect() == []


def test_test_data(spark, data):
    got = {tuple(r) for r in queries()["op13_periodic_runs"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in rows if len(words_of(r.text)) < 1500]
    assert len(got) == len(rows) and len(some) > 150
    assert all(expected(r.doc_id, r.text) in got for r in some)


def test_no_shuffle(spark, data):
    plan = queries()["op13_periodic_runs"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
