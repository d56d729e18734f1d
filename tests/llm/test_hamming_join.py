import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import EDGE, docs, prose
from oracle import compare, duck

from tomewright.llm import hamming_join as H
from tomewright.llm.catalog import oracle_sql, queries


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset([tuple(w)] if len(w) == 1 else zip(w, w[1:]))


def by_hand(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, comparing all pairs of sets."""
    members = {}
    for i, t in rows:
        if i is not None and shingles(t):
            members.setdefault(shingles(t), []).append(i)
    sets = list(members)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for a, s in enumerate(sets):
        low[find(a)] = min(low.get(find(a), 1 << 60), *members[s])
    place = {s: a for a, s in enumerate(sets)}
    out = []
    for i, t in rows:
        s = shingles(t)
        c = i if i is None or not s else low[find(place[s])]
        out.append((i, len(s), c, None if i is None else i == c))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def edited(seed, count, words=80, edits=9):
    """Copies of one text with so many words changed that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9999)}"
        yield " ".join(w)


def groups(seed):
    texts = [t for k in range(4) for t in edited(seed * 10 + k, 25, words=20 + 30 * k)]
    texts += [prose(seed + 500 + k, 25) for k in range(30)]
    ids = random.Random(seed).sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = [*EDGE, (20, "One"), (21, "oNE "), (22, "Ä b"), (23, "ä b"), (24, "a\x85b c"), (25, "a b a b a"), (26, "A\tB\x0bA"), (27, "a\x1cb c")]
    assert rows_of(H.near_duplicates(docs(spark, rows, extra))) == by_hand(rows)


@pytest.mark.parametrize("seed", range(2))
def test_equals_comparison_of_all_pairs(spark, seed):
    rows = groups(seed)
    assert len({r[2] for r in by_hand(rows)}) > 35
    assert rows_of(H.near_duplicates(docs(spark, rows))) == by_hand(rows)


@pytest.mark.parametrize("sizes", [(3, 2), (10, 10)])
def test_large_groups_are_split_without_losing_links(spark, sizes):
    rows = [(k, t) for k, t in enumerate([*edited(3, 70, edits=12), *edited(4, 40, words=30, edits=3)])]
    got = H.near_duplicates(docs(spark, rows), signature_block=sizes[0], set_block=sizes[1])
    assert rows_of(got) == by_hand(rows)


def test_a_chain_longer_than_a_block_is_one_component(spark):
    words = prose(8, 260).split()
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(50)]
    assert {r[2] for r in by_hand(rows)} == {0}
    assert rows_of(H.near_duplicates(docs(spark, rows), signature_block=4, set_block=4)) == by_hand(rows)


def test_texts_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(H.common, "BROADCAST_IDS", 0)
    rows = groups(5) + [(1, "twice"), (1, "twice")]
    assert rows_of(H.near_duplicates(docs(spark, rows))) == by_hand(rows)


def test_one_id_with_several_texts(spark):
    a, b = prose(31, 50), prose(32, 50)
    for rows in ([(7, a), (7, b), (8, a + " more"), (9, b + " more")], [(7, b), (7, a), (9, b + " more"), (8, a + " more"), (7, a)]):
        assert rows_of(H.near_duplicates(docs(spark, rows))) == by_hand(rows)


def test_all_pairs_within_the_distance_share_a_key(spark):
    """Pigeonhole: any 2 * chunks - 1 differing places leave a chunk with at most one of them."""
    rng = np.random.default_rng(1)
    chunks, width = 4, 3
    rows = []
    for k in range(200):
        a = rng.integers(0, 256, chunks * width, dtype=np.uint8)
        b = a.copy()
        for at in rng.choice(chunks * width, 2 * chunks - 1, replace=False):
            b[at] = (int(b[at]) + rng.integers(1, 256)) % 256
        rows += [(2 * k, a.tobytes()), (2 * k + 1, b.tobytes())]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "id bigint, s binary")
    keys = {r.id: set(r.k) for r in df.select("id", H.chunk_keys(df.s, chunks, width, 1).alias("k")).collect()}
    assert len(keys[0]) == chunks * len(list(combinations(range(width), 1)))
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(200))


def test_signatures_differ_as_similarity_says():
    rng = np.random.default_rng(2)
    factors = np.array([H.xxhash.xxh3_64_intdigest(b"order %d" % k) | 1 for k in range(400)], np.uint64)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    near = np.append(base[100:], rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    a, b = H.minhashes(base, factors), H.minhashes(near, factors)
    assert abs((a == b).mean() - 0.8) < 0.07


def test_near_sets_are_exact():
    texts = [b"a b c d e f", b"a b c d e g", b"a b c d e", b"x"]
    keys = [H.set_key(H.WordSets(2).of(t)) for t in texts]
    block = H.NearSets(pa.table({"text": texts, "set_key": keys}), 2, 80, 100)
    assert block.valid.all() and block.near(0, np.array([1, 2, 3])).tolist() == [False, True, False]
    wrong = H.NearSets(pa.table({"text": texts, "set_key": keys[::-1]}), 2, 80, 100)
    assert not wrong.valid.any()


def test_empty_table(spark):
    assert rows_of(H.near_duplicates(docs(spark, []))) == []


def test_sql_twin(spark, data):
    ok, note = compare(spark, duck(data), "op12_hamming_dedup", queries()["op12_hamming_dedup"], oracle_sql()["op12_hamming_dedup"], data)
    assert ok, note
