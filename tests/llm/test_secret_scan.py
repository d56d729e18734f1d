import hashlib
import math
import random
import re

import pytest
from fixtures import EDGE, docs

from tomewright.llm import secret_scan as S


def base_by_hand(text):
    out = []
    pos = 0
    assign = re.compile(
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    while m := assign.search(text, pos):
        pos = m.end()
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(out)


def entropy_by_hand(run, window, hex_bits, mixed_bits):
    covered = []
    for s in range(len(run) - window + 1):
        w = run[s : s + window]
        e = -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w))
        is_hex = set(w) <= set("0123456789abcdefABCDEF")
        if e >= (hex_bits if is_hex else mixed_bits) - 1e-9:
            covered.append((s, s + window, "entropy_hex" if is_hex else "entropy_mixed"))
    merged = []
    for s, e, k in covered:
        if merged and merged[-1][2] == k and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], e, k)
        else:
            merged.append((s, e, k))
    return merged


def test_incremental_entropy_equals_recount():
    rng = random.Random(5)
    for _ in range(300):
        run = "".join(rng.choice(rng.choice(["abcdef0123456789", "aA1/+=-_zZ9qQ7", "ab"])) for _ in range(rng.randint(0, 70)))
        assert S.window_entropy_spans(run, 20, 3.0, 3.6) == entropy_by_hand(run, 20, 3.0, 3.6)


def test_scan_equals_brute_force(spark):
    rng = random.Random(9)
    pieces = [
        "password=abc", "PASSWORD : 'abcdefghijkl'", "api_key=\"A1b2C3d4E5f6\"", "apikey = short", "AKIA1234567890ABCD", "AKIAAKIA",
        "AKIA" + "X" * 40, "0123456789abcdef", "deadbeef", "ſecret=aaaaaaaaaaaaaaa", "toKen=x.y-z_0=1/2+3", "tokentoken=abcdefabcdefabcd",
        "secret=", "é🙂", "\n", " ", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "kQ9z+/Zx81LmPq0RtY6u", "supercalifragilisticexpialidocious",
        "123e4567-e89b-12d3-a456-426614174000", "4041894974608795404189", "passwd passwd=passwordpassword",
    ]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = {r.doc_id: r for r in S.scan_secrets(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = base_by_hand(t)
        joined = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        every = r.spans.split(",") if r.spans else []
        assert set(joined.split(",") if joined else []) <= set(every)


def test_entropy_finds_what_no_pattern_names_and_leaves_words_alone(spark):
    rows = [(1, "key kQ9z+/Zx81LmPq0RtY6uWc"), (2, "supercalifragilisticexpialidociouslyspelled"), (3, "2024-01-02-03-04-05-06-07-08"),
            (4, "123e4567-e89b-12d3-a456-426614174000"), (5, "--------------------------------")]
    got = {r.doc_id: r.spans for r in S.scan_secrets(docs(spark, rows)).collect()}
    assert got[1] == "entropy_mixed:4:26" and not any(got[i] for i in (2, 3, 4, 5))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    got = S.scan_secrets(docs(spark, EDGE, extra)).collect()
    assert len(got) == len(EDGE)
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id in (1, 2, 3))
    assert S.scan_secrets(docs(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(1, "a password=abcdefabcdefabcdef b AKIA1234567890ABCD c"), (2, None), (3, "clean"), (4, "")]
    df = docs(spark, rows, extra=True)
    out = S.redact_secrets(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [secret] b [secret] c", 2: None, 3: "clean", 4: ""}
