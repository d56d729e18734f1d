import random

import numpy as np
from fixtures import EDGE, docs, prose
from oracle import compare, duck

from tomewright.llm import ngram_join as N
from tomewright.llm.catalog import oracle_sql, queries


def shingles(text):
    w = (text or "").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def by_hand(rows):
    """(id, class, links, copies) of every row, comparing all pairs of sets."""
    members = {}
    for i, t in rows:
        if i is not None and shingles(t):
            members.setdefault(shingles(t), []).append(i)
    sets = list(members)
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c * 5 >= 4 * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for a, s in enumerate(sets):
        low[find(a)] = min(low.get(find(a), 1 << 60), *members[s])
    place = {s: a for a, s in enumerate(sets)}
    out = []
    for i, t in rows:
        s = shingles(t)
        out.append((i, i, 0, 1) if i is None or not s else (i, low[find(place[s])], links[place[s]], len(members[s])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()), key=str)


def near_copies(seed, count, words=120, edits=2):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
        yield " ".join(w)


def test_hot_groups_cut_into_blocks(spark):
    texts = [*near_copies(1, 150), *near_copies(2, 30, edits=6), *([prose(50, 80)] * 60), *(prose(k, 60) for k in range(100, 160))]
    shared = prose(77, 25)
    texts += [shared + " " + prose(k, 60) for k in range(200, 260)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    want = by_hand(rows)
    for block_rows in (192, 16):
        assert rows_of(N.jaccard_classes(docs(spark, rows), block_rows=block_rows)) == want


def test_edges(spark):
    rows = [*EDGE, (20, prose(3, 40).upper()), (21, "one"), (22, "One \t"), (23, "a b c d e"), (24, "a b c d e f")]
    for extra in (False, True):
        assert rows_of(N.jaccard_classes(docs(spark, rows, extra))) == by_hand(rows)
    assert N.jaccard_classes(docs(spark, [])).count() == 0


def test_same_id_with_other_texts(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(1, 50)), (3, prose(2, 50))]
    assert {r.doc_id: r.class_id for r in N.jaccard_classes(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1}


def test_near_texts_under_a_shared_id(spark):
    near = list(near_copies(5, 3, edits=1))
    rows = [(7, near[0]), (7, prose(2, 50)), (7, None), (7, near[0]), (8, near[1]), (9, near[2]), (10, prose(2, 50) + " more")]
    want = [r for r in by_hand(rows) if r[3]]
    for order in (rows, rows[::-1]):
        df = docs(spark, order).coalesce(1)
        assert rows_of(N.jaccard_classes(df)) == want
        assert {r.doc_id for r in N.keep_one_of_each(df).collect()} == {7}


def test_minhash_estimates_similarity():
    s = N.Shingler(5)
    a, b = list(near_copies(9, 2, words=400, edits=8))
    x, y = s.shingles(a), s.shingles(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    f = N._hash_factors(512)
    assert abs((N.minhashes(x, f) == N.minhashes(y, f)).mean() - true) < 0.1
    assert N.forest_depth(16, 5, 0.8, 0.999) == 4 and N.forest_depth(16, 5, 0.8, 0.5) == 5


def test_one_of_each_stays(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(3, 10, edits=1))] + [(50, prose(8, 40)), (51, prose(8, 40)), (52, None), (None, prose(8, 40))]
    df = docs(spark, rows, extra=True)
    kept = N.keep_one_of_each(df)
    want = {i for i, c, _, _ in by_hand(rows) if i == c}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_sql(spark, data):
    ok, note = compare(spark, duck(data), "op1_ngram_jaccard", queries()["op1_ngram_jaccard"], oracle_sql()["op1_ngram_jaccard"], data)
    assert ok, note


def test_no_text_is_shuffled_to_drop_copies(spark):
    rows = [(k, t) for k, t in enumerate(near_copies(9, 40))] + [(100 + k, prose(60 + k, 30)) for k in range(20)]
    kept = N.keep_one_of_each(docs(spark, rows))
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_ids_are_shuffled_with_the_same_result(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(near_copies(9, 40))] + [(100 + k, prose(60 + k, 30)) for k in range(20)]
    want = sorted(r.doc_id for r in N.keep_one_of_each(docs(spark, rows)).collect())
    monkeypatch.setattr(N.sent_ids, "__defaults__", (0,))
    assert sorted(r.doc_id for r in N.keep_one_of_each(docs(spark, rows)).collect()) == want
