"""Exact semantic search and best match; the approximate one is in ``buckets``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions.vectors import is_usable
from docquarry.operators import scoring


def valid_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.filter(is_usable(F.col(col)))


def semantic_topk(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.LIST_DEPTH,
    *,
    scope: str | None = None,
    **options,
) -> DataFrame:
    """Exact best ``k`` chunks per question by cosine: ``(query_id, id, score, rank)``.

    ``scope`` names a column of both tables (such as ``category``); a question
    whose value is set sees only chunks with the same value.
    """
    q = valid_vectors(questions, "query_vec").select(
        "query_id", F.col("query_vec").cast("array<double>"), *scoring.scoped(questions, scope), *scoring.permitted(questions))
    c = valid_vectors(chunks).select("id", "embedding", *scoring.scoped(chunks, scope), *scoring.permitted(chunks))
    return scoring.best_k(scoring.VectorBlock, q, c, k, **options)


def semantic_top1(questions: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """The best match of each question."""
    return semantic_topk(questions, chunks, 1, **options).drop("rank")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact list that an approximate list holds, per question."""
    hit = exact.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


