"""Registered retrieval queries: every vector asks, every vector answers, itself left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.catalog.tables import table
from tomewright.functions import vectors as V
from tomewright.operators import context as C
from tomewright.operators import inverted_file as IVF
from tomewright.operators.topk import overlap_at_k, overlap_verdict, postfilter, similarity_topk
from tomewright.plans.cascade import search_distinct
from tomewright.session import checkpoint_folder, durable
from tomewright.sources.files import read_vector_file
from tomewright.plans import living_index
from tomewright.sources.sinks import read_index, write_index, write_vector_files

K = 5
FLOOR = 0.35  # the fixture has no pair near the default floors
N_PROBE = 3

ALL_PAIRS = """pairs AS (
  SELECT q.vec_id AS qid, c.vec_id AS vec_id, q.label AS q_label, c.label AS c_label,
         list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
           / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS sim
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)"""
RANKED = ALL_PAIRS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rnk FROM pairs)"""
COARSE = ALL_PAIRS + f""", cells AS (
  SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos), centroids AS (
  SELECT label, list(m ORDER BY pos) AS c FROM cells GROUP BY label), probes AS (
  SELECT vec_id AS qid, e.label AS own, c.label, row_number() OVER (PARTITION BY vec_id ORDER BY
    list_inner_product(embedding::DOUBLE[], c.c) DESC, c.label) AS pr FROM embeddings e CROSS JOIN centroids c),
  coarse AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.qid ORDER BY sim DESC, vec_id) AS rnk
  FROM pairs p JOIN probes b ON p.qid = b.qid AND p.c_label = b.label WHERE b.pr <= {N_PROBE})"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")


def _exact(spark: SparkSession, d: str, k: int = K, floor: float | None = None) -> DataFrame:
    return similarity_topk(_vectors(spark, d), _asked(spark, d), k, skip_self=True, floor=floor)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


def vector_topk_exact(spark, d):
    return _rounded(_exact(spark, d))


def vector_topk_prefilter(spark, d):
    """Each query searches its own label only."""
    hits = similarity_topk(_vectors(spark, d), _asked(spark, d), K, cell=("label", "label"), skip_self=True)
    return _rounded(hits)


def vector_topk_postfilter(spark, d):
    """Ten times the wanted rows first, label test afterwards."""
    labels = _vectors(spark, d).select("vec_id", "label")
    wanted = labels.withColumnRenamed("vec_id", "qid")
    return _rounded(postfilter(_exact(spark, d, K * 10), labels, wanted, K))


def relevance_floor(spark, d):
    kept = C.relevance_floor(_exact(spark, d, floor=FLOOR), _asked(spark, d), FLOOR)
    return kept.select(
        "qid",
        F.coalesce("vec_id", F.lit(-1)).alias("vec_id"),
        F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity"),
        "no_match",
    )


def relevance_band(spark, d):
    pct = F.col("similarity") * 100
    return _exact(spark, d).select("qid", "rank", C.relevance_band(pct, high=40.0, medium=30.0).alias("band"))


def _stretched(spark, d):
    return _vectors(spark, d).withColumn(
        "embedding", F.transform("embedding", lambda x: x * (F.col("label") + 1).cast("float"))
    )


def l2_normalize(spark, d):
    """Unit vectors of stretched input, each summed up by position-weighted sum, ends and norms."""
    x = F.col("unit")
    out = V.l2_normalize(_stretched(spark, d).withColumn("unit", F.col("embedding")), "unit")
    weighted = F.aggregate(
        F.transform(x, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )
    return out.select(
        "vec_id",
        F.round(V.norm(F.col("embedding")), 4).alias("norm_in"),
        F.round(V.norm(x), 4).alias("norm_out"),
        F.round(F.element_at(x, 1).cast("double"), 5).alias("first_x"),
        F.round(F.element_at(x, -1).cast("double"), 5).alias("last_x"),
        F.round(weighted, 3).alias("weighted"),
    )


def vector_file_rows(spark, d):
    """All vectors written as a raw float32 matrix and read again by byte ranges: the row number is the id."""
    path = f"{checkpoint_folder(spark)}/matrix-{uuid.uuid4().hex}"
    vectors = _vectors(spark, d)
    dim = vectors.select(F.size("embedding").alias("d")).first()["d"]
    write_vector_files(vectors, path, dim)
    x = F.col("embedding")
    return read_vector_file(spark, path, dim, range_bytes=64 * 1024).select(
        "vec_id", F.size(x).alias("dim"), F.round(F.element_at(x, 1).cast("double"), 6).alias("first_x"),
        F.round(F.element_at(x, -1).cast("double"), 6).alias("last_x"),
        F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), 6).alias("sum_x"),
    )


def vector_profile(spark, d):
    return V.profile(_vectors(spark, d), "embedding", ["label"])


def _coarse(spark, d):
    members = _vectors(spark, d).withColumn("cell", F.col("label").cast("long"))
    centroids = V.group_means(members, "embedding", "cell")
    return IVF.probe_topk(members, _asked(spark, d).drop("label"), centroids, K, N_PROBE, skip_self=True)


def vector_topk_coarse(spark, d):
    """Label means as coarse cells, the nearest three probed."""
    return _rounded(_coarse(spark, d))


def _label_cells(spark, d):
    members = _vectors(spark, d).withColumn("cell", F.col("label").cast("long"))
    return members, V.group_means(members, "embedding", "cell")


def vector_topk_pruned(spark, d):
    """The exact rows, cells that cannot hold one of the best left out by centre and radius."""
    members, centroids = _label_cells(spark, d)
    balls = durable(IVF.cell_balls(members, centroids))
    return _rounded(IVF.pruned_topk(members, _asked(spark, d).drop("label"), balls, K, skip_self=True))


def vector_topk_stored_index(spark, d):
    """The same cells as a written index: folders of probed cells are read, found by a join at run time."""
    path = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    write_index(*_label_cells(spark, d), path)
    members, cells = read_index(spark, path)
    return _rounded(IVF.probe_topk(members, _asked(spark, d).drop("label"), cells, K, N_PROBE, skip_self=True))


def vector_topk_living_index(spark, d):
    """An index of two thirds of the vectors, some of them wrong, takes in the rest and the right ones in two batches."""
    path = f"{checkpoint_folder(spark)}/living-{uuid.uuid4().hex}"
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    third = F.col("vec_id") % 3
    living_index.build(vectors.where(third < 2).withColumn("embedding", F.when(third == 0, F.reverse("embedding")).otherwise(F.col("embedding"))), path, 16)
    for batch in (vectors.where(third == 2), vectors.where(third == 0)):
        living_index.ingest(batch, path)
    members, balls = living_index.read(spark, path)
    return _rounded(IVF.pruned_topk(members, _asked(spark, d).drop("label"), balls, K, skip_self=True))


def vector_topk_ivf(spark, d):
    """Cells from k-means."""
    vectors = _vectors(spark, d)
    centroids = IVF.train_cells(vectors, "embedding", 16)
    members = IVF.nearest_cells(vectors, "embedding", centroids, 1)
    return _rounded(IVF.probe_topk(members, _asked(spark, d).drop("label"), centroids, K, 4, skip_self=True))


def ivf_train(spark, d):
    vectors = _vectors(spark, d)
    members = IVF.nearest_cells(vectors, "embedding", IVF.train_cells(vectors, "embedding", 16), 1)
    return members.groupBy("cell").agg(F.count(F.lit(1)).alias("n_members"))


def recall_at_k(spark, d):
    return overlap_at_k(_exact(spark, d), _coarse(spark, d), K, _asked(spark, d))


def recall_summary(spark, d):
    return overlap_verdict(recall_at_k(spark, d))


def _search_log(spark, d):
    """Every event is one search: its user picks the query vector, its type the number of rows, its hour a filter."""
    wanted = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    only = F.when(F.hour("ts") < 12, F.col("user_id") % 10)
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("qid"), wanted.alias("k"), F.coalesce(only, F.lit(-1)).cast("int").alias("within"))


def dedup_search(spark, d):
    """Searches that repeat query, number of rows and label filter are made once, for all who asked."""
    vectors, asked = _vectors(spark, d), _asked(spark, d)

    def search(distinct: DataFrame) -> DataFrame:
        own = asked.drop("label")
        free = similarity_topk(vectors, own.join(distinct.where("within < 0"), "qid", "left_semi"), 3, skip_self=True).withColumn("within", F.lit(-1))
        bound = own.join(distinct.where("within >= 0").select("qid", "within").distinct(), "qid")
        within = similarity_topk(vectors, bound, 3, cell=("label", "within"), skip_self=True)
        hits = free.unionByName(within.join(bound.select("qid", "within"), "qid"), allowMissingColumns=True)
        return distinct.join(hits, ["qid", "within"]).where("rank <= k")

    hits = search_distinct(_search_log(spark, d), ["qid", "k", "within"], search)
    return _rounded(hits).select("event_id", "qid", "k", "within", "rank", "vec_id", "similarity")


def _mode(label: str):
    return F.when(F.col(label) < 5, "text").otherwise("voice")


def semantic_cache_lookup(spark, d):
    """Best cached answer of the same mode at or above the threshold, else -1."""
    cache = _vectors(spark, d).withColumn("mode", _mode("label"))
    asked = _asked(spark, d).withColumn("mode", _mode("label"))
    hits = similarity_topk(
        cache, asked, 1, cell=("mode", "mode"), prefer="vec_id", floor=FLOOR, skip_self=True
    )
    return asked.join(hits, "qid", "left").select(
        "qid",
        "mode",
        F.coalesce("vec_id", F.lit(-1)).alias("cached_id"),
        F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity"),
    )


def _passages(spark, d, k: int, text: str = "text") -> DataFrame:
    """Hits with their text: the wide text column joins after the top-k has been taken."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("scripture"), F.expr(text).alias("text")
    )
    hits = _exact(spark, d, k).join(docs, "vec_id", "left").withColumn("chunk_id", F.col("vec_id"))
    return C.with_defaults(hits)


def context_assembly(spark, d):
    questions = _vectors(spark, d).select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("What is near vector "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"),
    )
    used = f"substring(text, 1, {C.MAX_PASSAGE_CHARS})"  # the part of a passage that a context shows
    return C.assemble_context(_passages(spark, d, 10, used), questions)


def source_diversity(spark, d):
    return C.source_diversity(_passages(spark, d, 10, "''"))


def history_passages(spark, d):
    """Stored passages read back; answers of label 0 carry broken JSON and so have none."""
    stored = C.encode_passages(_passages(spark, d, K)).join(_asked(spark, d).select("qid", "label"), "qid")
    text = F.when(
        F.col("label") == 0, F.expr("substring(passages_json, 1, length(passages_json) - 3)")
    ).otherwise(F.col("passages_json"))
    back = stored.select("qid", C.decode_passages(text).alias("p"))
    zero = F.lit(0.0)
    shown = F.transform("p", lambda p: C.shown_similarity(p["similarity"]))
    return back.select(
        "qid",
        F.size("p").cast("long").alias("n_passages"),
        F.round(F.aggregate(shown, zero, lambda s, x: s + x), 4).alias("sum_shown"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + F.length(p["text"])).alias("n_chars"),
        F.array_join(F.transform("p", lambda p: p["chunk_id"]), ",").alias("chunk_ids"),
    )


PASSAGES_SQL = RANKED + """, passages AS (
  SELECT qid, rnk, r.vec_id, sim, coalesce(source, 'Unknown') AS scripture, coalesce(text, '') AS text, q_label
  FROM ranked r LEFT JOIN documents ON r.vec_id = doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_exact, vector_topk_prefilter, vector_topk_postfilter, vector_topk_coarse, vector_topk_ivf,
        vector_topk_pruned, vector_topk_stored_index, vector_topk_living_index, ivf_train, recall_at_k, recall_summary, relevance_floor, relevance_band, l2_normalize, vector_profile, vector_file_rows,
        dedup_search, semantic_cache_lookup, context_assembly, source_diversity, history_passages,
    )
}

_OVERLAP = COARSE + f""", truth AS (
  SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rnk
  FROM pairs) WHERE rnk <= {K}), shared AS (
  SELECT e.vec_id AS qid, count(c.vec_id)::BIGINT AS n_shared
  FROM embeddings e LEFT JOIN (SELECT c.qid, c.vec_id FROM coarse c JOIN truth t
    ON c.qid = t.qid AND c.vec_id = t.vec_id WHERE c.rnk <= {K}) c ON e.vec_id = c.qid GROUP BY e.vec_id),
  overlap AS (SELECT qid, n_shared, round(n_shared * 100.0::DOUBLE / {K}, 2) AS overlap_pct FROM shared)"""

def _trained_sql(cells: int, rounds: int = 4) -> str:
    """k-means with the same first centres, its rounds written out."""
    unit = "list_transform(c, lambda x: x / sqrt(list_inner_product(c, c)))"
    parts = [f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c0 AS (
  SELECT cell, {unit} AS c FROM (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, e AS c FROM v) WHERE cell < {cells})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, e, cell FROM v, c{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(e, c) DESC, cell) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS (SELECT cell, {unit} AS c FROM (SELECT cell, list(m ORDER BY pos) AS c FROM (
  SELECT cell, pos, avg(x) AS m FROM (SELECT cell, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{r}) GROUP BY ALL) GROUP BY cell))""")
    return ", ".join(parts)


SQL = {
    "ivf_train": f"WITH {_trained_sql(16)} SELECT cell, count(*) AS n_members FROM a4 GROUP BY cell",
    "vector_topk_ivf": f"""WITH {ALL_PAIRS}, {_trained_sql(16)}, probed AS (
  SELECT vec_id AS qid, cell FROM v, c4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(e, c) DESC, cell) <= 4),
  r AS (SELECT p.qid, p.vec_id, sim, row_number() OVER (PARTITION BY p.qid ORDER BY sim DESC, p.vec_id) AS rnk
  FROM pairs p JOIN a4 ON a4.vec_id = p.vec_id JOIN probed ON probed.qid = p.qid AND probed.cell = a4.cell)
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rnk <= {K}""",
    "vector_topk_exact": f"""WITH {RANKED}
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM ranked WHERE rnk <= {K}""",
    "vector_topk_prefilter": f"""WITH {ALL_PAIRS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rnk FROM pairs
  WHERE q_label = c_label)
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rnk <= {K}""",
    "vector_topk_postfilter": f"""WITH {RANKED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rnk) AS again FROM ranked
  WHERE rnk <= {K * 10} AND q_label = c_label)
SELECT qid, again AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE again <= {K}""",
    "vector_topk_coarse": f"""WITH {COARSE}
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM coarse WHERE rnk <= {K}""",
    "vector_topk_pruned": f"""WITH {RANKED}
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM ranked WHERE rnk <= {K}""",
    "vector_topk_living_index": f"""WITH {RANKED}
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM ranked WHERE rnk <= {K}""",
    "vector_topk_stored_index": f"""WITH {COARSE}
SELECT qid, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM coarse WHERE rnk <= {K}""",
    "recall_at_k": f"WITH {_OVERLAP} SELECT qid, n_shared, overlap_pct FROM overlap",
    "recall_summary": f"""WITH {_OVERLAP}
SELECT round(avg(overlap_pct), 4) AS mean_pct, min(overlap_pct) AS min_pct, max(overlap_pct) AS max_pct,
  CASE WHEN avg(overlap_pct) >= 95 THEN 'pass' WHEN avg(overlap_pct) >= 80 THEN 'acceptable' ELSE 'fail' END
  AS verdict FROM overlap""",
    "relevance_floor": f"""WITH {RANKED}, kept AS (SELECT * FROM ranked WHERE rnk <= {K} AND sim >= {FLOOR})
SELECT e.vec_id AS qid, coalesce(k.vec_id, -1) AS vec_id, coalesce(round(sim, 6), 0.0) AS similarity,
  k.vec_id IS NULL AS no_match FROM embeddings e LEFT JOIN kept k ON e.vec_id = k.qid""",
    "relevance_band": f"""WITH {RANKED}
SELECT qid, rnk AS rank, CASE WHEN sim * 100 >= 40 THEN 'high' WHEN sim * 100 >= 30 THEN 'medium' ELSE 'low' END
  AS band FROM ranked WHERE rnk <= {K}""",
    "l2_normalize": """WITH s AS (
  SELECT vec_id, list_transform(embedding, lambda x: (x * (label + 1)::FLOAT)::FLOAT::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v)))::FLOAT::DOUBLE) AS w FROM s)
SELECT vec_id, round(sqrt(list_inner_product(v, v)), 4) AS norm_in,
  round(sqrt(list_inner_product(w, w)), 4) AS norm_out, round(w[1], 5) AS first_x, round(w[-1], 5) AS last_x,
  round(list_sum(list_transform(w, lambda x, i: x * i)), 3) AS weighted FROM u""",
    "vector_file_rows": """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(embedding)::INTEGER AS dim,
  round(embedding[1]::DOUBLE, 6) AS first_x, round(embedding[-1]::DOUBLE, 6) AS last_x,
  round(list_sum(embedding::DOUBLE[]), 6) AS sum_x FROM embeddings""",
    "vector_profile": """SELECT label, count(*) AS n_vectors, min(len(embedding)) AS min_dim,
  max(len(embedding)) AS max_dim, sum(len(embedding) * 4)::BIGINT AS float32_bytes FROM embeddings GROUP BY label""",
    "dedup_search": f"""WITH {ALL_PAIRS}, asked AS (
  SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS k,
    CASE WHEN hour(ts) < 12 THEN user_id % 10 ELSE -1 END::INTEGER AS within FROM events), hits AS (
  SELECT a.*, p.vec_id, sim, row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, p.vec_id) AS rnk
  FROM asked a JOIN pairs p ON a.user_id = p.qid AND (within < 0 OR c_label = within))
SELECT event_id, user_id AS qid, k, within, rnk AS rank, vec_id, round(sim, 6) AS similarity FROM hits WHERE rnk <= k""",
    "semantic_cache_lookup": f"""WITH {ALL_PAIRS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id DESC) AS rnk FROM pairs
  WHERE (q_label < 5) = (c_label < 5) AND sim >= {FLOOR})
SELECT e.vec_id AS qid, CASE WHEN label < 5 THEN 'text' ELSE 'voice' END AS mode,
  coalesce(r.vec_id, -1) AS cached_id, coalesce(round(sim, 6), 0.0) AS similarity
FROM embeddings e LEFT JOIN r ON e.vec_id = r.qid AND rnk = 1""",
    "context_assembly": f"""WITH {PASSAGES_SQL}, c AS (
  SELECT qid, count(*) AS n, string_agg('[Passage ' || rnk || '] ' || scripture || ' (relevance: '
    || printf('%.1f%%', sim * 100) || ')' || chr(10) || substr(text, 1, 800), chr(10) || chr(10) ORDER BY rnk) AS body
  FROM passages WHERE rnk <= 10 GROUP BY qid)
SELECT e.vec_id AS qid, coalesce(n, 0) AS n_passages, 'Passages:' || chr(10) || chr(10) || coalesce(body, '')
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: What is near vector ' || e.vec_id || '?' AS context
FROM embeddings e LEFT JOIN c ON e.vec_id = c.qid""",
    "source_diversity": f"""WITH {PASSAGES_SQL}
SELECT qid, count(*) AS n_passages, count(DISTINCT scripture) AS n_sources FROM passages WHERE rnk <= 10
GROUP BY qid""",
    "history_passages": f"""WITH {PASSAGES_SQL}
SELECT qid, count(*) FILTER (q_label <> 0) AS n_passages,
  round(coalesce(sum(CASE WHEN round(sim, 4) = 0 THEN 0.5 ELSE round(sim, 4) END) FILTER (q_label <> 0), 0.0), 4)
    AS sum_shown,
  coalesce(sum(length(text)) FILTER (q_label <> 0), 0)::BIGINT AS n_chars,
  coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY rnk) FILTER (q_label <> 0), '') AS chunk_ids
FROM passages WHERE rnk <= {K} GROUP BY qid""",
}
