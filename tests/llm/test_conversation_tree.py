import hashlib
import random
import zlib

import pytest
from oracle import duck

from tomewright.llm import conversation_tree as C
from tomewright.llm.catalog import oracle_sql, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("pos", "block", "level", "ka", "t1", "digest", "depth", "span"))))
    return df


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def digest(x):
        return hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()

    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2], digest(x)))] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def nodes(spark, rows, extra=False):
    return got(C.prefix_nodes(C.with_shared_heads(table(spark, rows, extra))))


def made(seed, convs=60, longest=20, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, longest])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same " * rng.randrange(alphabet)))
    rng.shuffle(rows)
    return rows


EDGE = [
    (100, None, None, None), (100, 0, "user", ""), (100, 1, "", "user"), (101, 1, "user", None), (101, 1, "user", "tie"), (101, 1, "user", "tie"),
    (101, 2, "assistant", "é🙂 long " * 3000), (None, 1, "user", "no id"), (-7, 3, "user", "negative"), (-100, 2, "user", "base of -107"),
    (-107, 0, "a", "b"), (-107, 1, "a", "c"), (5, -3, "ab", "c"), (5, 0, "a", "bc"), (7, 5, None, "alone"),
]


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = EDGE + [(200 + k, 0, "user", "one turn") for k in range(12)]
    assert nodes(spark, rows, extra) == by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_tree_built_by_hand(spark, seed):
    rows = made(seed)
    assert nodes(spark, rows) == by_hand(rows)


def test_long_conversations_go_on_in_further_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(C, "SPAN", 2)
    rows = made(7, convs=25, longest=90, alphabet=2)
    rows += [(c, t, "user", f"{t % 5}") for c in (300, 301, 302, 303) for t in range(100 + c % 4)]
    assert nodes(spark, rows) == by_hand(rows)


def test_turns_of_a_conversation_may_span_ranges(spark, monkeypatch):
    from tomewright.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    monkeypatch.setitem(ordered.running_sum.__kwdefaults__, "rows_per_range", 40)
    rows = [(100, t, "user", f"{t % 3}") for t in range(150)] + made(4, convs=20)
    assert nodes(spark, rows) == by_hand(rows)


def test_ids_of_copies_pass_as_pieces(spark):
    ends = spark.range(5000).selectExpr("id AS conv_id", "1L AS depth", "if(id % 3 = 0, 5L, id) AS ka", "0L AS kb")
    found = {r.ka: r.ends_sha256 for r in C._digests(ends, piece=7).collect()}
    want = {}
    for k in range(5000):
        want.setdefault(5 if k % 3 == 0 else k, []).append(str(k))
    assert found == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_all_without_turns(spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert rows and nodes(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert nodes(spark, []) == []


def test_sql_twin(spark, data):
    for folder in (data, data.replace("sf0.001", "sf0.01")):
        theirs = duck(folder).execute(oracle_sql()["op11_conversation_rollup"])
        assert [c[0] for c in theirs.description] == COLUMNS
        assert got(queries()["op11_conversation_rollup"](spark, folder)) == sorted(theirs.fetchall(), key=str)


def test_texts_are_not_shuffled(spark, data):
    turns = C.ordered_turns(spark.read.parquet(f"{data}/conversations.parquet"))
    assert "text" not in turns.columns and "Expand" in C._rollup(C.turn_blocks(turns), "count(*) AS n")._jdf.queryExecution().executedPlan().toString()
