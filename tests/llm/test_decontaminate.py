from fixtures import EDGE, docs, prose

from tomewright.llm import decontaminate as D
from tomewright.llm.catalog import queries

ITEMS = "item_id bigint, text string"
ASK = "A train leaves the old station at 9 and travels 120 km before Maria changes to the slow bus for 35 minutes."


def find(spark, rows, items, **how):
    got = D.find_leaks(docs(spark, rows), spark.createDataFrame(items, ITEMS), **how).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def test_verbatim_items(spark):
    """Every document that holds a whole item is found, and no other."""
    d = "/root/testdata/sf0.01"
    words = lambda t: " ".join(t.split())
    texts = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, b in items.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in queries()["op2_template_decontamination"](spark, d).collect()}
    assert want and got == want


def test_reparameterised_questions_and_slots(spark):
    other = ASK.replace("9", "7:30").replace("120 km", "45 miles").replace("Maria", "Pedro").replace("35 minutes", "2 hours")
    glued = ASK.replace("120 km", "80km")
    item = "If Ada has 5 coins and gives 5 coins to the quiet boy then he holds 8 coins at the end"
    consistent = item.replace("5", "6")
    mixed = "If Ada has 5 coins and gives 4 coins to the quiet boy then he holds 8 coins at the end"
    rows = [(1, prose(1, 50) + " " + other + " " + prose(2, 50)), (2, prose(3, 40) + ". " + ASK), (3, prose(4, 100)), (4, glued), (5, consistent), (6, mixed), (7, ASK.upper())]
    got = find(spark, rows, [(10, ASK), (11, prose(9, 30)), (12, item)])
    assert {k for k in got if k[1] == 10} == {(1, 10), (2, 10), (4, 10)}
    assert (got[1, 10].exact, got[2, 10].exact) == (False, True)
    assert (5, 12) in got and (6, 12) not in got
    assert not [k for k in got if k[0] == 3 or k[1] == 11]


def test_windows_of_placeholders_alone_match_nothing(spark):
    table = " ".join(str(k) for k in range(40))
    assert not find(spark, [(1, table)], [(1, " ".join(str(k * 3) for k in range(40)))])


def test_edges(spark):
    items = [(1, None), (2, ""), (3, "too short to match"), (None, prose(5, 30)), (4, prose(3, 40)), (4, prose(3, 40))]
    got = find(spark, EDGE, items)
    assert set(got) == {(7, 4)} and got[7, 4].n_windows == got[7, 4].n_item_windows == 33
    assert not find(spark, [], items) and not find(spark, EDGE, [])
    df = docs(spark, EDGE, extra=True)
    kept = D.drop_leaks(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns and kept.count() == len(EDGE) - 2


def test_filter_never_decides(spark):
    rows = [(i, prose(i, 60)) for i in range(30)]
    df, bench = docs(spark, rows), spark.createDataFrame([(i, prose(i, 60)) for i in range(0, 30, 3)], ITEMS)
    whole = D.template_windows(df, "doc_id", "text", 8, 6)
    bits = spark.sparkContext.broadcast(D._filter_bitmap(bench, "item_id", "text", 8, 6))
    some = D.template_windows(df, "doc_id", "text", 8, 6, bits)
    wanted = D.template_windows(bench, "item_id", "text", 8, 6).select("template")
    key = lambda d: sorted((r.doc_id, r.pos) for r in d.join(wanted.distinct(), "template").collect())
    assert key(whole) == key(some) and some.count() < whole.count()


def test_copies_rich_in_placeholders(spark):
    """Windows grow until they hold enough plain words; items without such windows are found word for word."""
    days = "How many days are there in 3 weeks and 4 days if Anna works 5 hours a day"
    german = "Welche Stadt liegt am Ufer der Elbe zwischen Dresden und Hamburg im Norden von Sachsen?"
    short, names = "What is 12 times 15?", "Anna Berta Carla Dora Emma Frieda Greta Hanna Ida Johanna"
    changed = days.replace("3", "7").replace("Anna", "Olga").replace("5", "6")
    hidden = lambda k, t: (k, prose(k, 40) + ". " + t + " " + prose(k + 50, 40))
    rows = [hidden(1, days), hidden(2, german), hidden(3, short), hidden(4, names), hidden(5, changed), hidden(6, "What is 12 times 16?"), hidden(7, prose(8, 9))]
    got = find(spark, rows, [(1, days), (2, german), (3, short), (4, names), (5, "Two words"), (6, None)])
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)}
    assert got[1, 1].exact and not got[5, 1].exact


def test_one_unequal_slot_leaves_the_copied_words(spark):
    item = "If Ada has 5 coins and gives 5 coins to the quiet boy then he holds 8 coins at the end"
    tail = " while the old man waits under a wide tree and the river runs on to the sea"
    got = find(spark, [(1, item.replace("gives 5", "gives 4") + tail), (2, item + tail)], [(1, item + tail)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].n_windows < got[2, 1].n_windows == got[2, 1].n_item_windows


def _brute(docs_, items, size=8, concrete=6, enough=6, shortest=4):
    """Leaks by plain comparison of all windows of all texts, built word by word."""

    def tokens(text):
        out, ended = [], True
        for raw in text.split():
            core = raw.strip(D.EDGES)
            low = core.lower()
            if core:
                slot = D.NUM if low in D.NUMBER_WORDS or D.NUMBER.fullmatch(core) else D.UNIT if low in D.UNITS else None
                out.append((low, slot, D.NAME if slot is None and core[0].isupper() and not ended else None))
                ended = False
            ended = ended or raw[-1] in ".!?:…" or len(raw) > 1 and raw[-2] in ".!?"
        return out

    def windows(words):
        for i in range(len(words)):
            parts, slots, plain = [], [], 0
            for j, (low, slot, name) in enumerate(words[i : i + 8 * size]):
                kind = slot or (name if j else None)
                parts.append(kind or low)
                slots += [(kind, low)] if kind else []
                plain += not kind
                if len(parts) >= size and plain >= concrete:
                    yield i, tuple(parts), tuple(slots)
                    break

    def stretches(mine, asked):
        """Per diagonal the slots of all pairs of windows with equal templates."""
        out = {}
        for i, t, s in mine:
            for k, u, v in asked:
                if t == u:
                    out.setdefault(i - k, []).append(list(zip(v, s)))
        return out.values()

    leaks = set()
    for d, text in docs_:
        words = tokens(text)
        mine = list(windows(words))
        for k, item in items:
            asked_words = tokens(item)
            asked = list(windows(asked_words))
            need = min(enough, len(asked))
            for met in stretches(mine, asked):
                pairs = {p for m in met for p in m}
                fair = len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
                own = [m for m in met if all(a == b for a, b in m)]
                if len(met if fair else own) >= need and (fair or 2 * len(own) > len(asked)):
                    leaks.add((d, k))
            n = min(size, len(asked_words))
            if len(asked) < enough and len(asked_words) >= shortest:
                cut = lambda w: [(i, tuple(x[0] for x in w[i : i + n]), ()) for i in range(len(w) - n + 1)]  # noqa: B023,E731
                for met in stretches(cut(words), cut(asked_words)):
                    if len(met) >= min(enough, len(asked_words) - n + 1):
                        leaks.add((d, k))
    return leaks


def test_brute_force(spark):
    """Windows, slots and stretches of random questions with numbers, names and units, whole and altered."""
    import random

    rng = random.Random(5)
    plain = "the old man walks from a town to his house and buys some bread with milk before it rains".split()
    marked = ["3", "7", "12", "km", "hours", "Anna", "Bert", "Cora", "five"]

    def say(n, share):
        return [rng.choice(marked if rng.random() < share else plain) for _ in range(n)]

    items = [(k, say(rng.choice([3, 5, 7, 9, 14, 25]), rng.choice([0.1, 0.4, 0.8]))) for k in range(40)]
    rows = []
    for d in range(120):
        words = say(20, 0.3)
        for _, item in rng.sample(items, 2):
            swap = {m: rng.choice(marked) for m in marked} if rng.random() < 0.5 else {}
            kept = item if rng.random() < 0.7 else item[: len(item) * 2 // 3]
            words += [swap.get(w, w) if rng.random() < 0.95 else w for w in kept] + say(6, 0.3) + ["end."]
        rows.append((d, " ".join(words)))
    texts = [(k, " ".join(w)) for k, w in items]
    want = _brute(rows, texts)
    assert len(want) > 60 and set(find(spark, rows, texts)) == want
