import random
from collections import Counter, deque

import pytest

from tomewright.operators import stateful as ST

S = ST.MICROS


def events(seed, n=900, span=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.4 else rng.randint(1, 20)
        rows.append((i, user, rng.randint(0, span) * S, rng.random() < 0.5))
    return rows


def limiter_model(rows, limit, window):
    seen, out = {}, {}
    for i, user, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        q = seen.setdefault(user, deque())
        while q and at - q[0] > window * S:
            q.popleft()
        if len(q) >= limit:
            out[i] = "rejected"
        else:
            q.append(at)
            out[i] = "accepted"
    return out


def breaker_model(rows, failures, window, recovery):
    state, out = {}, {}
    for i, user, at, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(user, {"open": None, "fail": []})
        closed = ""
        if s["open"] is not None:
            if at - s["open"] < recovery * S:
                out[i] = "blocked"
                continue
            s["open"], s["fail"], closed = None, [], "closed_"
        if not failed:
            s["fail"] = []
            out[i] = closed + "success"
            continue
        s["fail"] = [t for t in s["fail"] + [at] if at - t <= window * S]
        if len(s["fail"]) >= failures:
            s["open"] = at
            out[i] = closed + "opened"
        else:
            out[i] = closed + "failure"
    return out


def decide(spark, rows, machine):
    df = spark.createDataFrame(rows, "id bigint, user bigint, at bigint, failed boolean").repartition(5)
    got = ST.keyed_decisions(df, machine, key="user", at="at", id_col="id", flag="failed")
    return {r.id: r.decision for r in got.collect()}


def test_limiter_equals_model(spark):
    rows = events(1)
    got = decide(spark, rows, ST.Limiter(5, 60))
    assert got == limiter_model(rows, 5, 60)
    assert Counter(got.values())["rejected"] > 50


def test_breaker_equals_model(spark):
    rows = events(2)
    got = decide(spark, rows, ST.Breaker(3, 60, 300))
    assert got == breaker_model(rows, 3, 60, 300)
    assert {"blocked", "opened", "closed_success", "failure"} <= set(got.values())


def test_never_more_than_the_limit_in_any_window(spark):
    rows = events(5, 400, 500)
    got = decide(spark, rows, ST.Limiter(4, 30))
    for user in {r[1] for r in rows}:
        at = sorted(r[2] for r in rows if r[1] == user and got[r[0]] == "accepted")
        assert all(b - a > 30 * S for a, b in zip(at, at[4:], strict=False))


@pytest.mark.parametrize("pause", [1, 20, 61, 301, 5_000])
def test_pieces_of_a_busy_and_a_quiet_key(spark, pause):
    """One key overloaded throughout, bursts with pauses of every kind, and a row without a key."""
    rows = [(i, 1, i * S // 3, i % 2 == 0) for i in range(900)]
    rows += [(1000 + i, 2, (i // 4) * pause * S + i % 4, i % 5 != 0) for i in range(400)]
    assert decide(spark, rows, ST.Limiter(3, 60)) == limiter_model(rows, 3, 60)
    assert decide(spark, rows, ST.Breaker(3, 60, 300)) == breaker_model(rows, 3, 60, 300)
    assert set(decide(spark, [(1, None, 0, True), (2, None, 1, True)], ST.Limiter(1, 60)).values()) == {"accepted", "rejected"}


def test_window_edges():
    step = ST.Limiter(1, 60).step
    log, _ = step([], 0, False)
    assert step(log, 60 * S, False)[1] == "rejected"
    assert step(log, 60 * S + 1, False)[1] == "accepted"
    step = ST.Breaker(2, 60, 300).step
    state, _ = step([], 0, True)
    state, d = step(state, 60 * S, True)
    assert d == "opened"
    assert step(state, 60 * S + 300 * S - 1, False)[1] == "blocked"
    assert step(state, 360 * S, False)[1] == "closed_success"


def test_fixture_regression(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    count = Counter(r.decision for r in entry.queries()["rate_limit"](spark, sf).collect())
    assert count == {"accepted": 7567, "rejected": 2433}
    count = Counter(r.decision for r in entry.queries()["circuit_breaker"](spark, sf).collect())
    assert count["opened"] + count["closed_opened"] == 281 and count["blocked"] == 1731
    assert sum(n for d, n in count.items() if d.startswith("closed_")) == 248


def test_ledger_with_refunds(spark):
    rows = [(i, 1, i, i % 3 != 0, 2) for i in range(9)] + [(100 + i, 2, i, True, 0) for i in range(2)]
    df = spark.createDataFrame(rows, "id bigint, user bigint, at bigint, kept boolean, quota bigint")
    got = ST.quota_ledger(df, by=["user"], order=["at", "id"], quota="quota", kept="kept", rows_per_range=3)
    left, want = {1: 2, 2: 0}, {}
    for i, user, _, kept, _q in rows:
        if left[user] <= 0:
            want[i] = ("refused", 0)
        elif kept:
            left[user] -= 1
            want[i] = ("charged", left[user])
        else:
            want[i] = ("refunded", left[user])
    assert {r.id: (r.decision, r.remaining) for r in got.collect()} == want


def test_cascade_order_and_charges(spark):
    from pyspark.sql import functions as F

    from tomewright.operators import caches as C
    from tomewright.plans.cascade import route_questions

    rows = [
        (0, 1, " Known FAQ ", None, 0.9), (1, 1, "old one", None, 0.9), (2, 1, "weak", None, 0.1), (3, 1, "cached weak", 5, 0.1),
        (4, 1, "good", None, 0.9), (5, 1, "too many", None, 0.9), (6, 1, "known faq", None, 0.9), (7, 2, "old one", None, None),
    ]
    q = spark.createDataFrame(rows, "seq bigint, user_id bigint, question string, cached_id bigint, best double").withColumn("quota", F.lit(2))
    faq = C.faq_index(spark.createDataFrame([(1, "Known faq")], "faq_id int, t string"), "t", "faq_id", ["faq_id"])
    old = spark.createDataFrame([(1, "Old one", 1), (1, "old ONE ", 2)], "user_id bigint, t string, answer_id int")
    history = C.history_index(old, "user_id", "t", "answer_id", ["answer_id"])
    for ranges in (100, 2):
        got = {r.seq: (r.route, r.charged) for r in route_questions(q, faq, history, rows_per_range=ranges).collect()}
        assert got == {
            0: ("faq", False), 1: ("exact", False), 2: ("no_match", False), 3: ("semantic", True), 4: ("answer", True),
            5: ("refused", False), 6: ("faq", False), 7: ("no_match", False),
        }
    first = {r.seq: r.route for r in route_questions(q, faq, history, floor_first=True).collect()}
    assert first[3] == "no_match" and first[5] == "answer"


def decide_in_parts(spark, rows, machine, part_rows, rounds=4):
    heard = []
    df = spark.createDataFrame(rows, "id bigint, user bigint, at bigint, failed boolean").repartition(5)
    got = ST.keyed_decisions(
        df, machine, key="user", at="at", id_col="id", flag="failed", part_rows=part_rows, rounds=rounds, told=lambda *x: heard.append(x)
    )
    return {r.id: r.decision for r in got.collect()}, heard


def test_a_calm_key_that_never_pauses_takes_two_rounds(spark):
    """An event every 20 seconds for hours: 32 parts, settled when the second round finds nothing wrong."""
    rows = [(i, 1, i * 20 * S, i % 7 == 0) for i in range(1280)]
    got, heard = decide_in_parts(spark, rows, ST.Limiter(5, 60), 40)
    assert got == limiter_model(rows, 5, 60)
    assert len(heard) == 2 and 25 <= heard[0][1] <= 32 and heard[1][1] == 0
    got, heard = decide_in_parts(spark, rows, ST.Breaker(3, 60, 300), 40)
    assert got == breaker_model(rows, 3, 60, 300) and heard[-1][1] == 0 and len(heard) <= 3


@pytest.mark.parametrize("rounds", [1, 2, 4, 60])
def test_states_that_depend_on_each_other_throughout(spark, rounds):
    """Overloaded without a pause, beside quiet keys: exact whether rounds suffice or the rest is one stream."""
    rng = random.Random(rounds)
    rows = [(i, 1, i * S // 3 + rng.randrange(S), i % 2 == 0) for i in range(900)]
    rows += [(1000 + i, 2, i * 700 * S, True) for i in range(40)] + [(2000 + i, None, i * 9 * S, i % 3 != 0) for i in range(300)]
    for machine, want in ((ST.Limiter(3, 60), limiter_model(rows, 3, 60)), (ST.Breaker(3, 60, 300), breaker_model(rows, 3, 60, 300))):
        got, heard = decide_in_parts(spark, rows, machine, 45, rounds)
        assert got == want
        assert heard[0][1] > 10


def test_parts_and_pauses_together(spark):
    rows = [(i, 1, (i + (i // 200) * 2000) * S, i % 3 == 0) for i in range(900)]
    for machine, want in ((ST.Limiter(3, 60), limiter_model(rows, 3, 60)), (ST.Breaker(3, 60, 300), breaker_model(rows, 3, 60, 300))):
        assert decide_in_parts(spark, rows, machine, 30)[0] == want


def test_late_search_sees_open_questions_only_and_vectors_once(spark, data):
    from pyspark.sql import functions as F

    from tomewright.operators import caches
    from tomewright.plans.cascade import best_and_cached, route_questions

    q = spark.createDataFrame([(1, 7, 1, "known"), (2, 7, 2, "new"), (3, 8, 3, "new"), (4, 9, 4, "other")], "qid bigint, user_id bigint, seq bigint, question string").withColumn("quota", F.lit(5))
    faq = caches.faq_index(spark.createDataFrame([("known", 1, 5)], "text string, n bigint, faq_id bigint"), "text", "n", ["faq_id"])
    history = caches.history_index(spark.createDataFrame([(9, "other", 1, 6)], "user_id bigint, text string, n bigint, answer_id bigint"), "user_id", "text", "n", ["answer_id"])
    seen = []

    def search(open_):
        seen.extend(r.qid for r in open_.collect())
        return open_.select("qid", F.when(F.col("qid") == 2, 0.9).alias("best"), F.when(F.col("qid") == 3, F.lit(4)).cast("long").alias("cached_id"))

    got = {r.seq: r.route for r in route_questions(q, faq, history, search=search, floor=0.5).collect()}
    assert sorted(seen) == [2, 3] and got == {1: "faq", 2: "answer", 3: "semantic", 4: "exact"}

    from tomewright.operators.topk import similarity_topk

    df = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("mode", F.when(F.col("label") < 5, "text").otherwise("voice"))
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "mode")
    both = best_and_cached(df, asked, ["text", "voice"], floor=0.4, skip_self=True)
    best = {r.qid: r.similarity for r in similarity_topk(df, asked, 1, skip_self=True).collect()}
    own = {r.qid: r.vec_id for r in similarity_topk(df, asked, 1, cell=("mode", "mode"), prefer="vec_id", floor=0.4, skip_self=True).collect()}
    rows = both.collect()
    assert {r.qid: r.best for r in rows} == best and {r.qid: r.cached_id for r in rows if r.cached_id is not None} == own
    assert both._jdf.queryExecution().optimizedPlan().toString().count("embedding") > 0


def test_prefix_orders_only_what_comes_before_the_target(spark):
    from pyspark.sql import functions as F

    from tomewright.operators import stats

    clips = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 977 * 10).alias("ms"))
    total = 3_000_000
    got = stats.prefix_until(clips, "doc_id", "ms", total)
    place = F.conv(F.substring(F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    at, want = 0, {}
    for r in clips.withColumn("p", place).orderBy("p", "doc_id").collect():
        if at >= total:
            break
        want[r.doc_id] = at
        at += r.ms + stats.CLIP_GAP_MS
    assert {r.doc_id: r.before_ms for r in got.collect()} == want and 100 < len(want) < 2_000
    tagged = clips.select("doc_id", "ms", place.alias("place"))
    kept = stats.before_target(tagged, F.floor(F.col("place") / (1 << 52) * stats.PREFIX_CELLS), F.col("ms") + stats.CLIP_GAP_MS, total).count()
    assert len(want) <= kept < len(want) + 20
    falling = clips.withColumn("ms", F.when(F.col("doc_id") % 2 == 0, -10_000).otherwise(F.col("ms")))
    assert stats.before_target(falling, F.col("doc_id"), F.col("ms"), 10).count() == 20_000
