import math
import re
import textwrap

from fixtures import EDGE, docs, prose
from oracle import compare, duck

from tomewright.llm import license_scan as L
from tomewright.llm.catalog import oracle_sql, queries


def words_of(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def bag(text):
    w = words_of(text)
    out, seen = set(), {}
    for a, b in zip(w, w[1:]):
        seen[a, b] = seen.get((a, b), 0) + 1
        out.add((a, b, seen[a, b]))
    return out


def told(form, t):
    """Telling bigrams of a template."""
    first = len(form) - math.ceil(len(form) * t / (2 - t) - 1e-9) + 1
    return set(sorted((" ".join(p) for p in form), key=lambda p: (-len(p), p))[:first])


def by_hand(rows, templates, t=0.8):
    """Every line, every whole text and every stretch of a template's length against every template."""
    found = {}

    def met(place, a, b, license_id):
        dice = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
        if dice >= t:
            found.setdefault(place, []).append((-dice, -len(a), license_id))

    forms = []
    for i, x in templates:
        w = words_of(x)
        forms.append((i, bag(x), list(zip(w, w[1:]))))
    for doc, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        for n, unit in [*enumerate(lines), *([(-1, " ".join(lines))] if len(lines) > 1 else [])]:
            for i, form, _ in forms:
                met((doc, n), bag(unit), form, i)
        flat = [(w, n) for n, line in enumerate(lines) for w in words_of(line)]
        pairs = [(a, b) for (a, _), (b, _) in zip(flat, flat[1:])]
        for i, form, listed in forms:
            rare = told(listed, t) if listed else ()
            for a in range(len(pairs) - len(listed) + 1 if listed else 0):
                if any(p == q and " ".join(q) in rare for p, q in zip(pairs[a:], listed)):
                    met((doc, flat[a][1]), bag(" ".join(w for w, _ in flat[a : a + len(listed) + 1])), form, i)
    return {k: (min(v)[2], round(-min(v)[0], 12), -min(v)[1]) for k, v in found.items()}


def scan(spark, df, templates):
    got = L.scan_licenses(df, L.template_frame(spark, templates)).collect()
    return {(r.doc_id, r.line_no): (r.license_id, round(r.dice, 12), r.n_bigrams) for r in got}


def test_equals_brute_force(spark):
    short = dict(L.TEMPLATES)
    rows = [
        (1, "Licensed under CC BY-NC 4.0.\n" + prose(1, 60)), (2, prose(2, 30) + "\nreleased under the mit license"), (3, "ALL RIGHTS  RESERVED"),
        (4, "\n".join(L.TEMPLATES[4][1].split(", "))), (5, "Licensed under the Apache License, Version 2.0. " * 8), (6, short["CC0-1.0"].replace("author", "people who made it")),
        (7, "This work is licensed under the GNU General Public License version 3 or 2"), (8, "the the the the the the\nof the of the of the"), (9, "under the"),
        (10, "Licensed under CC BY 4.0\n\n\n"), *EDGE,
    ]
    want = by_hand(rows, L.TEMPLATES)
    assert len(want) >= 8
    for extra in (False, True):
        assert scan(spark, docs(spark, rows, extra), L.TEMPLATES) == want
    repeated = [("a", "the of the of the of the"), ("b", "of the of the"), ("c", "word"), ("d", "")]
    assert scan(spark, docs(spark, rows), repeated) == by_hand(rows, repeated)


def test_notices_inside_longer_texts(spark):
    full = next(x for i, x in L.TEMPLATES if i == "MIT" and "NONINFRINGEMENT" in x)
    notice = L.TEMPLATES[4][1]
    rows = [
        (1, prose(1, 300) + "\n" + textwrap.fill(notice, 60) + "\n" + prose(2, 300)), (2, "Copyright 2020 Acme. All rights reserved. Call us."),
        (3, textwrap.fill("MIT License Copyright 2021 Somebody " + full, 80)), (4, prose(3, 40) + " " + notice.replace("Software", "Library", 1) + " " + prose(4, 40)),
        (5, prose(5, 200) + " rights reserved all"), (6, (L.TEMPLATES[-1][1] + "\n" + notice) * 2), (7, "Licensed under the\nApache License, Version\n2.0 and all rights\n\nreserved"),
    ]
    want = by_hand(rows, L.TEMPLATES)
    got = scan(spark, docs(spark, rows + rows[:2]), L.TEMPLATES)
    assert got == want
    assert want[1, 1][:2] == ("MIT", 1.0) and want[2, 0] == ("proprietary", 1.0, 2) and want[4, 0][0] == "MIT"
    assert ("MIT", 1.0) in {v[:2] for k, v in want.items() if k[0] == 3} and {v[0] for k, v in want.items() if k[0] == 6} == {"MIT", "ISC"}
    assert {v[0] for k, v in want.items() if k[0] == 7} == {"Apache-2.0", "proprietary"} and not any(k[0] == 5 for k in want)


def test_many_templates_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [(1, prose(1, 30) + "\n" + textwrap.fill(L.TEMPLATES[4][1], 50)), (2, "x All rights reserved. y"), *EDGE]
    want = scan(spark, docs(spark, rows), L.TEMPLATES)
    monkeypatch.setattr(L, "MOST_TOLD", 3)
    assert scan(spark, docs(spark, rows), L.TEMPLATES) == want == by_hand(rows, L.TEMPLATES)


def test_empty(spark):
    assert scan(spark, docs(spark, []), L.TEMPLATES) == {}
    none = spark.createDataFrame([], "license_id string, template string")
    assert L.scan_licenses(docs(spark, EDGE), none).count() == 0


def test_plan_has_no_python_and_no_cross_join(spark, data):
    plan = queries()["op7_license_dice"](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_sql(spark, data):
    ok, note = compare(spark, duck(data), "op7_license_dice", queries()["op7_license_dice"], oracle_sql()["op7_license_dice"], data)
    assert ok, note
