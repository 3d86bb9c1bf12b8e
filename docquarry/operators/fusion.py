"""Reciprocal-rank fusion, de-duplication, reranking, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import fixed
from docquarry.functions.text import keywords, let, stem_of, strip, words
from docquarry.session import fan_out


def _lists(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both ranked lists side by side: one shuffle on (query, chunk)."""
    none = F.lit(None).cast("int")
    both = semantic.select("query_id", "id", F.col("rank").alias("s"), none.alias("k"), F.col("score").alias("sim")).unionByName(
        keyword.select("query_id", "id", none.alias("s"), F.col("rank").alias("k"), F.lit(None).cast("double").alias("sim")))
    return both.groupBy("query_id", "id").agg(
        F.max("s").alias("sem_rank"), F.max("k").alias("kw_rank"), F.max("sim").alias("sim"))


def rrf_fusion(semantic: DataFrame, keyword: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Ranks from 1; a list that lacks the chunk adds nothing."""
    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))

    return _lists(semantic, keyword).withColumn("rrf", part("sem_rank") + part("kw_rank"))


def rrf_fusion_limited(semantic: DataFrame, keyword: DataFrame, limit: Column | int,
                       k: int = fixed.RRF_K) -> DataFrame:
    """Ranks from 0; a list that lacks the chunk counts as rank ``limit``."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def part(rank: str) -> Column:
        return 1.0 / (k + F.coalesce(F.col(rank) - 1, limit))

    return _lists(semantic, keyword).withColumn("rrf", part("sem_rank") + part("kw_rank"))


def dedup_key(content: Column, chars: int = fixed.DEDUP_KEY_CHARS) -> Column:
    return F.substring(F.lower(strip(content)), 1, chars)


def text_keys(chunks: DataFrame) -> DataFrame:
    """``id, _key``: a digest of the leading text of every chunk that has one."""
    return chunks.select("id", dedup_key(F.col("content")).alias("_key")).filter("_key <> ''").withColumn("_key", F.unhex(F.md5("_key")))


def candidate_dedup(candidates: DataFrame, cap: int = fixed.CANDIDATE_CAP) -> DataFrame:
    """Best fused row per (question, leading text), then the first ``cap`` rows.

    Adds ``place``, the row's place in the fused order. Blank texts are dropped. Candidates without their texts bring
    the ``_key`` of :func:`text_keys`.
    """
    w = Window.partitionBy("query_id", "_key").orderBy(F.col("rrf").desc(), "id")
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    keyed = fan_out(candidates, "query_id")
    if "_key" not in candidates.columns:
        # naming a candidate column keeps this test on the candidates; alone it would be
        # moved to the scan and lower every text of the index
        keyed = keyed.withColumn("_key", dedup_key(F.col("content"))).filter((F.col("_key") != "") | (F.col("rrf") <= 0))
    return (
        keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_key")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap))


def source_dedup(candidates: DataFrame, cap: int = fixed.CANDIDATE_CAP) -> DataFrame:
    """Best fused row per (question, source), then the first ``cap`` rows."""
    w = Window.partitionBy("query_id", "source").orderBy(F.col("rrf").desc(), "id")
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    return (
        fan_out(candidates, "query_id").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap))


def lexical_score(query: Column, content: Column, chars: int = fixed.RERANK_CHARS) -> Column:
    """Default pair score: share of the question's words found, plus their density."""
    def score(p: Column) -> Column:
        terms, tokens = p["terms"], p["tokens"]
        found = F.size(F.array_intersect(terms, tokens))
        hits = F.size(F.filter(tokens, lambda t: F.array_contains(terms, t)))
        return F.when((F.size(terms) == 0) | (F.size(tokens) == 0), F.lit(0.0)).otherwise(
            F.round(found / F.size(terms) + hits / F.size(tokens), 6))

    # bound once: inside the filter they would be worked out again for every word
    return let(F.struct(
        F.array_distinct(keywords(query)).alias("terms"),
        words(F.lower(F.substring(content, 1, chars))).alias("tokens")), score)


def rerank(candidates: DataFrame, scorer=None) -> DataFrame:
    """Replace the score by a pair score; ties keep the fused order.

    ``scorer(query, content)`` returns a Column: the native lexical score by
    default, or a pandas UDF around a model.
    """
    scorer = scorer or lexical_score
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    return (
        candidates.withColumn("score", scorer(F.col("query"), F.col("content")).cast("double"))
        .withColumn("place", F.row_number().over(w)))


def names_document(query: Column, source: Column) -> Column:
    """The question contains the file's stem, as it is or with signs as spaces."""
    stem, q = stem_of(source), F.lower(query)

    def plain(c: Column) -> Column:
        return F.regexp_replace(c, "[^a-z0-9]+", " ")

    return (stem != "") & (F.contains(q, stem) | F.contains(plain(q), plain(stem)))


def named_doc_boost(candidates: DataFrame, boost: float = fixed.NAME_BOOST) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    lifted = candidates.withColumn("named", names_document(F.col("query"), F.col("source")))
    return lifted.withColumn(
        "score", F.when(F.col("named"), F.col("score") + boost).otherwise(F.col("score"))
    ).withColumn("place", F.row_number().over(w))


def similarity_guard(candidates: DataFrame, floor: float = fixed.SIMILARITY_FLOOR) -> DataFrame:
    """Drop all rows of a question whose best similarity stays below the floor."""
    best = F.max("semantic_score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("_best", best).filter(F.col("_best") >= floor).drop("_best")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


