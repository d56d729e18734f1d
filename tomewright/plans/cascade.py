"""Routes a batch of questions: FAQ, quota, exact history, semantic cache, retrieval, floor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.operators import caches
from tomewright.operators.context import RELEVANCE_FLOOR
from tomewright.operators.ordered import RANGE_ROWS, range_bounds
from tomewright.operators.stateful import quota_ledger
from tomewright.operators.topk import similarity_topk


def route_questions(
    questions: DataFrame,
    faq: DataFrame,
    history: DataFrame,
    *,
    floor: float = RELEVANCE_FLOOR,
    floor_first: bool = False,
    search: Callable[[DataFrame], DataFrame] | None = None,
    search_on: str = "qid",
    rows_per_range: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``route`` (faq, exact, semantic, no_match, answer, refused) and ``charged``.

    ``questions``: id columns, ``user_id``, ``seq`` (order of arrival), ``question``, ``quota``,
    ``cached_id`` (semantic cache hit or null), ``best`` (best similarity or null). ``faq`` and
    ``history`` are the indexes of ``caches.faq_index`` (``faq_id``) and ``caches.history_index``
    (``answer_id``). ``floor_first`` tests the floor ahead of the semantic cache, as streaming does.

    With ``search`` the last two columns come from a late search: it gets the distinct ``search_on`` values of the
    questions that neither FAQ nor history answers and returns them with ``cached_id`` and ``best``.

    Batch rule: no question of the batch can hit an answer that the same batch creates.
    """
    q = caches.faq_hits(questions, faq, "question")
    q = caches.exact_hits(q, history, "user_id", "question")
    if search is not None:
        open_ = q.where("faq_id IS NULL AND answer_id IS NULL").select(search_on).distinct()
        q = q.join(search(open_), search_on, "left")
    weak = F.coalesce(F.col("best"), F.lit(-1.0)) < floor
    cached = F.col("cached_id").isNotNull()
    late = (
        F.when(weak, "no_match").when(cached, "semantic").otherwise("answer")
        if floor_first
        else F.when(cached, "semantic").when(weak, "no_match").otherwise("answer")
    )
    route = F.when(F.col("faq_id").isNotNull(), "faq").when(F.col("answer_id").isNotNull(), "exact").otherwise(late)
    routed = q.withColumn("route", route).withColumn("kept", F.col("route").isin("semantic", "answer"))
    # An FAQ answer costs nothing and passes an empty quota, and it never counts as kept: the ledger may
    # see all rows at once.
    bounds = range_bounds(questions.select("seq"), F.col("seq"), rows_per_range)
    settled = quota_ledger(
        routed, by=["user_id"], order=["seq"], quota="quota", kept="kept", bounds=bounds, costly=True
    )
    refused = (F.col("decision") == "refused") & (F.col("route") != "faq")
    return settled.select(
        *questions.columns, *(c for c in ("best", "cached_id") if search is not None),
        F.when(refused, "refused").otherwise(F.col("route")).alias("route"),
        ((F.col("decision") == "charged") & ~refused).alias("charged"),
    )


def best_and_cached(
    vectors: DataFrame, questions: DataFrame, modes: list[str], *, floor: float, mode: str = "mode", id_col: str = "vec_id", skip_self: bool = False
) -> DataFrame:
    """``(qid, best, cached_id)`` of ``questions(qid, qvec, mode)`` from one scan of the vectors.

    Each question asks every mode for its best vector. The best of all is ``best``; that of the question's own mode is
    ``cached_id`` if it reaches ``floor`` (of equal ones the largest id). ``modes`` lists all modes of ``vectors``.
    """
    each = questions.select("qid", "qvec", F.col(mode).alias("own"), F.explode(F.array(*map(F.lit, modes))).alias("asked"))
    each = each.withColumn("key", F.xxhash64("qid", "asked"))
    asked = each.select(F.col("key").alias("qid"), "qvec", "asked")
    hits = similarity_topk(vectors, asked, 2 if skip_self else 1, cell=(mode, "asked"), prefer=id_col, id_col=id_col)
    found = each.select("key", F.col("qid").alias("of"), "own", "asked").join(hits.withColumnRenamed("qid", "key"), "key")
    if skip_self:
        found = found.where(F.col("of") != F.col(id_col))
    cached = F.when((F.col("own") == F.col("asked")) & (F.col("similarity") >= floor), F.struct("similarity", id_col))
    return found.groupBy(F.col("of").alias("qid")).agg(F.max("similarity").alias("best"), F.max(cached)[id_col].alias("cached_id"))


def search_distinct(log: DataFrame, on: list[str], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Search each distinct request once and hand its rows to every repetition.

    ``search`` maps the distinct ``on`` columns to result rows that carry them.
    """
    return log.join(search(log.select(*on).distinct()), on)
