"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.strings import once
from tomewright.llm.common import stored

# Notices of common public licences, as they are written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
]

#: Up to so many different telling bigrams are looked for before rows are made of a text; with more, the join alone finds them.
MOST_TOLD = 20_000

#: Everything that is no letter, digit or line break.
MARKS = r"[^\p{L}\p{N}\n]+"


def template_frame(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(templates, "license_id string, template string")


def normalised(text: Column) -> Column:
    """Lower case; all but letters, digits and line breaks is one blank."""
    return F.regexp_replace(F.lower(text), MARKS, " ")


def line_words(text: Column) -> Column:
    """Words of every line."""
    return F.transform(F.split(normalised(text), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))


def pairs(words: Column) -> Column:
    """Neighbouring words in order; none for fewer than two."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def numbered(pairs: Column) -> Column:
    """Each pair with the number of its occurrence, so that intersecting arrays intersects bags."""
    return F.transform(
        pairs, lambda p, k: F.concat(p, F.lit(" "), F.size(F.filter(F.slice(pairs, 1, k + 1), lambda q: q == p)).cast("string"))
    )


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, words) of every line, and of the whole text as line -1 where it has several lines.

    A generator stands between the costly column and its uses, so that it is worked out once.
    """
    cut = docs.where(F.col(text).isNotNull()).select("doc_id", once(line_words(F.col(text))).alias("lines"))
    each = F.transform("lines", lambda x, k: F.struct(k.alias("line_no"), x.alias("words")))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line_no"), F.flatten("lines").alias("words"))))
    every = F.concat(each, F.coalesce(whole, F.slice(each, 1, 0)))
    return cut.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.line_no", "u.words")


def _is_told(pair: Column, rare: list[str] | None) -> Column:
    return F.lit(True) if rare is None else pair.isin(rare)


def _keyed(templates: DataFrame, t: float) -> DataFrame:
    """Templates by each of their telling bigrams, with the places where it stands.

    A match misses at most (1 - t / (2 - t)) of the template, so one of the first few bigrams in any fixed
    order must be there; long ones come first, as they are rarer.
    """
    forms = (
        templates.select("license_id", once(F.flatten(line_words(F.col("template")))).alias("words"))
        .where(F.size("words") > 1).select("license_id", once(pairs(F.col("words"))).alias("t_pairs"))
        .withColumn("t_size", F.size("t_pairs"))
    )
    first = (F.col("t_size") - F.ceil(F.col("t_size") * F.lit(t / (2 - t)) - 1e-9) + 1).cast("int")
    by_length = F.array_sort(F.transform("t_pairs", lambda b: F.struct((-F.length(b)).alias("l"), b.alias("b"))))
    told = forms.select(
        "license_id", "t_size", "t_pairs", numbered(F.col("t_pairs")).alias("t_numbered"),
        F.explode(F.array_distinct(F.transform(F.slice(by_length, 1, first), lambda s: s["b"]))).alias("bigram"),
    )
    every = F.transform("t_pairs", lambda b, k: F.struct(b.alias("b"), k.alias("k")))
    places = F.transform(F.filter(every, lambda s: s["b"] == F.col("bigram")), lambda s: s["k"])
    return told.withColumn("places", places)


def _near_units(docs: DataFrame, text: str, keyed: DataFrame, rare: list[str] | None, sizes: tuple[int, int], t: float) -> DataFrame:
    """Lines and whole texts near a template."""
    low, high = sizes[0] * t / (2 - t) - 1e-9, sizes[1] * (2 - t) / t + 1e-9
    made = (
        units(docs, text).where((F.size("words") - 1).between(low, high))
        .select("doc_id", "line_no", once(pairs(F.col("words"))).alias("pairs"))
        .select("doc_id", "line_no", "pairs", F.size("pairs").alias("n_bigrams"), F.explode(F.array_distinct(F.filter("pairs", lambda p: _is_told(p, rare)))).alias("bigram"))
    )
    both = F.col("n_bigrams") + F.col("t_size")
    met = made.join(keyed, "bigram").where(
        F.col("n_bigrams").between(F.col("t_size") * (t / (2 - t)) - 1e-9, F.col("t_size") * ((2 - t) / t) + 1e-9)
        & (F.size(F.array_except("t_pairs", "pairs")) <= F.col("t_size") - both * (t / 2) + 1e-9)
    )
    dice = 2.0 * F.size(F.array_intersect(numbered(F.col("pairs")), "t_numbered")) / both
    return met.select("doc_id", "line_no", "n_bigrams", "license_id", once(dice).alias("dice"))


def _near_passages(docs: DataFrame, text: str, keyed: DataFrame, rare: list[str] | None, most: int, t: float) -> DataFrame:
    """Stretches of a template's length, across line breaks, near that template.

    Of each telling bigram only the words within a template's length around it leave the text.
    """
    cut = docs.where(F.col(text).isNotNull()).select("doc_id", once(line_words(F.col(text))).alias("lines"))
    lines_of = F.flatten(F.transform("lines", lambda x, k: F.array_repeat(k, F.size(x))))
    flat = cut.select("doc_id", once(lines_of).alias("lines_of"), F.flatten("lines").alias("words")).select(
        "doc_id", "lines_of", once(pairs(F.col("words"))).alias("pairs")
    )
    told = F.filter(F.transform("pairs", lambda p, k: F.struct(p.alias("bigram"), k.alias("at"))), lambda s: _is_told(s["bigram"], rare))

    def around(s: Column) -> Column:
        lo = F.greatest(s["at"] - (most - 1), F.lit(0))
        return F.struct(
            s["bigram"].alias("bigram"), (s["at"] - lo).alias("offset"),
            F.slice("pairs", lo + 1, 2 * most - 1).alias("near"), F.slice("lines_of", lo + 1, 2 * most - 1).alias("lines"),
        )

    spots = flat.select("doc_id", F.explode(F.transform(told, around)).alias("s")).select("doc_id", "s.*")
    start = F.col("offset") - F.col("place")
    placed = (
        spots.join(keyed, "bigram").select("*", F.explode("places").alias("place"))
        .where((start >= 0) & (start + F.col("t_size") <= F.size("near")))
        .select("doc_id", "license_id", "t_size", "t_pairs", "t_numbered", F.get("lines", start).alias("line_no"), F.slice("near", start + 1, F.col("t_size")).alias("pairs"))
        .where(F.size(F.array_except("t_pairs", "pairs")) <= F.col("t_size") * (1 - t) + 1e-9)
    )
    dice = F.size(F.array_intersect(numbered(F.col("pairs")), "t_numbered")) / F.col("t_size")
    return placed.select("doc_id", "line_no", F.col("t_size").alias("n_bigrams"), "license_id", once(dice).alias("dice"))


def scan_licenses(docs: DataFrame, templates: DataFrame, at_least: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, line_no, license_id, dice, n_bigrams): the nearest template of each line or text that is near one.

    Compared are every line, the whole text (line -1, where it has several) and passages: stretches of a
    template's length, within a line or across line breaks, that have one of its telling bigrams in its
    place; a passage belongs to the line it starts on. Telling are the longest bigrams of a template, as many
    as make sure that a near text has one of them.

    Two bags of a and b bigrams with c in common have the Dice coefficient 2c / (a + b). It can reach
    ``at_least`` only if b lies between a * t / (2 - t) and a * (2 - t) / t, only if a telling bigram
    is there and only few others are missing: those bounds prune before any bags are compared. Of equally near
    templates that with most bigrams wins, then the smaller id. Null and empty texts and texts of one word give no row,
    repeated rows give one; extra columns are ignored. Lines of any length are read; one with more bigrams than every
    template's bound is a match by its passages only. The templates are a table that Spark broadcasts while it is small.
    """
    # Written first, so that Spark knows how small it is and which side to broadcast.
    keyed = stored(_keyed(templates, at_least))
    least, most = keyed.agg(F.coalesce(F.min("t_size"), F.lit(1)), F.coalesce(F.max("t_size"), F.lit(0))).first()
    told = [r.bigram for r in keyed.select("bigram").distinct().limit(MOST_TOLD + 1).collect()]
    rare = told if len(told) <= MOST_TOLD else None
    near = _near_units(docs, text, keyed, rare, (least, most), at_least).unionByName(
        _near_passages(docs, text, keyed, rare, max(most, 1), at_least)
    ).where(F.col("dice") >= at_least)
    # The best: largest coefficient, then most bigrams, then the smaller id.
    best = F.min(F.struct((-F.col("dice")).alias("d"), (-F.col("n_bigrams")).alias("n"), F.col("license_id")))
    return near.groupBy("doc_id", "line_no").agg(best.alias("b")).select(
        "doc_id", "line_no", "b.license_id", (-F.col("b.d")).alias("dice"), (-F.col("b.n")).alias("n_bigrams")
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql(templates: list[tuple[str, str]], at_least: float = 0.8) -> str:
    """The same by comparing every line with every template of a fitting size, and every stretch a telling bigram places."""
    values = ", ".join(f"({k}, {_sql_text(i)}, {_sql_text(t)})" for k, (i, t) in enumerate(templates))
    words = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    made = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    bag = "list_transform(p, lambda x, i: x || ' ' || len(list_filter(p[1:i], lambda q: q = x)))"
    return f"""
WITH t AS (SELECT tid, license_id, p AS tp, len(p) AS tn, {bag} AS tb FROM (SELECT tid, license_id, {made} AS p FROM (
           SELECT tid, license_id, {words.format('template')} AS w FROM (VALUES {values}) v(tid, license_id, template)))),
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {words.format('x')}) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS w FROM l
      UNION ALL
      SELECT doc_id, -1, flatten(lines) FROM l WHERE len(lines) > 1),
g AS (SELECT doc_id, line_no, {bag} AS b FROM (SELECT doc_id, line_no, {made} AS p FROM u
      WHERE len(w) > 1 AND len(w) - 1 <= 2 * (SELECT max(tn) FROM t))),
c AS (SELECT doc_id, line_no, license_id, len(b) AS n, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
      FROM g, t WHERE len(b) <= 2 * len(tb) AND len(tb) <= 2 * len(b)),
f AS (SELECT row_number() OVER () AS r, doc_id, ln, {made} AS p FROM (SELECT doc_id, flatten(lines) AS w,
      flatten(list_transform(lines, lambda x, i: list_transform(x, lambda y: i - 1))) AS ln FROM l)),
tu AS (SELECT tid, tn, unnest(tp) AS pair, generate_subscripts(tp, 1) - 1 AS place FROM t),
told AS (SELECT DISTINCT tid, pair FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY length(pair) DESC, pair) AS k FROM tu)
         WHERE k <= tn - ceil(tn * ({at_least}::DOUBLE / (2 - {at_least}::DOUBLE)) - 1e-9) + 1),
placed AS (SELECT DISTINCT r, tid, spot - place AS a FROM (SELECT r, unnest(p) AS pair, generate_subscripts(p, 1) - 1 AS spot FROM f)
           JOIN (SELECT * FROM told JOIN tu USING (tid, pair)) USING (pair)),
passages AS (SELECT doc_id, line_no, license_id, tn AS n, len(list_intersect({bag}, tb)) / tn::DOUBLE AS dice
             FROM (SELECT doc_id, ln[a + 1] AS line_no, license_id, tn, tb, p[a + 1:a + tn] AS p
                   FROM placed JOIN f USING (r) JOIN t USING (tid) WHERE a >= 0 AND a + tn <= len(p)))
SELECT doc_id, line_no::INTEGER AS line_no, license_id, dice, n::INTEGER AS n_bigrams
FROM (SELECT * FROM c UNION ALL SELECT doc_id, line_no, license_id, n, dice FROM passages) WHERE dice >= {at_least}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, n DESC, license_id) = 1
"""
