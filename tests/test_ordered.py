import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import ordered as O
from tomewright.operators import stats as S


@pytest.mark.parametrize("rows_per_range", [10_000, 37, 5])
@pytest.mark.parametrize("by", [None, ["g"]])
@pytest.mark.parametrize("before", [False, True])
def test_running_sum_equals_plain_loop(spark, rows_per_range, by, before):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", rng.randint(0, 120), rng.randint(1, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, g string, at int, v bigint").repartition(6)
    got = O.running_sum(df, F.col("v"), ["at", "id"], "s", by=by, before=before, rows_per_range=rows_per_range)
    want, total = {}, {}
    for i, g, at, v in sorted(rows, key=lambda r: (r[2], r[0])):
        key = g if by else None
        seen = total.get(key, 0)
        total[key] = seen + v
        want[i] = seen if before else seen + v
    assert {r.id: r.s for r in got.collect()} == want


def test_shards_are_renumbered_in_order(spark):
    rows = [(s, p) for s in (2, 0, 1) for p in range(50)]
    df = spark.createDataFrame(rows, "shard int, position bigint")
    got = O.shard_merge(df, "shard", "position", rows_per_range=20).collect()
    assert {(r.shard, r.position): r.chunk_id for r in got} == {k: i for i, k in enumerate(sorted(rows))}


def test_parts_join_to_the_whole_text(spark):
    rows = [("a", i, f"text {i} " * (i % 7)) for i in range(120)] + [("b", 0, "only")]
    df = spark.createDataFrame(rows, "book string, n bigint, text string")
    parts = O.ordered_parts(df, "book", "n", "text", part_chars=200, rows_per_range=25).collect()
    assert max(len(p.text) for p in parts) < 400
    for b in "ab":
        whole = "\n\n".join(p.text for p in sorted((p for p in parts if p.book == b), key=lambda p: p.part))
        assert whole == "\n\n".join(t for k, _, t in rows if k == b)


def test_prefix_stops_at_target(spark):
    df = spark.createDataFrame([(i, 1000) for i in range(100)], "id bigint, ms bigint")
    got = S.prefix_until(df, "id", "ms", 15_000, rows_per_range=9).collect()
    assert sorted(r.before_ms for r in got) == [1500 * i for i in range(10)]


def test_budget_flags_low_rest(spark):
    df = spark.createDataFrame([(1, "a" * 4000, 4.0), (2, "b" * 5000, None), (3, "c", 5.5)], "n int, t string, paid double")
    got = {r.n: r for r in S.running_budget(df, "n", "t", "paid").collect()}
    assert got[2].cost_usd == round(1250 / 1e6 * 0.12, 4) == 0.0001
    assert got[3].total_usd == 9.5001 and got[3].low and not got[2].low


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 66, 127, 128, 500])
def test_range_number_is_the_count_of_cuts_passed(spark, n):
    cuts = [3 * i for i in range(n)]
    rows = spark.range(-2, 3 * n + 3).select("id", O.range_no(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in rows)


def test_chapters_have_heads(spark):
    rows = [("g", 2, 21, "b1"), ("g", 1, 12, "a2"), ("g", 1, 11, "a1"), ("h", 10, 101, "z")]
    df = spark.createDataFrame(rows, "book string, chapter int, place bigint, text string")
    parts = O.ordered_parts(O.with_chapter_heads(df, ["book"], "chapter", "place", "text"), "book", "place", "text").collect()
    line = "=" * 60
    head = lambda n: f"\n\n{line}\nCHAPTER {n}\n{line}\n\n"
    assert {r.book: r.text for r in parts} == {"g": head(1) + "a1\n\na2\n\n" + head(2) + "b1", "h": head(10) + "z"}
