"""Retrieval of whole question tables.

Inputs
    questions: ``query_id, query, query_vec, top_k`` (+ optional ``category``, ``tenant_id``, ``principals``)
    chunks:    ``id, source, source_type, location, content, embedding, category`` (+ ``tenant_id``, ``grants``)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import fixed
from docquarry.functions.text import strip, truncate
from docquarry.functions.vectors import cosine, is_usable
from docquarry.operators import fusion, scoring
from docquarry.operators.keyword import coverage_terms, idf_terms, keyword_idf, keyword_topk_many
from docquarry.operators.postings import Postings
from docquarry.operators.semantic import semantic_topk, valid_vectors
from docquarry.session import persist_table

VECTOR_ROWS = 100_000  # vectors per grid cell, where no texts go with them


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions of three characters or more, trimmed."""
    return questions.withColumn("query", strip(F.col("query"))).filter(F.length("query") >= 3)


def with_texts(
    candidates: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    chunk_columns: list[str],
    question_columns: list[str],
    bounded: bool,
) -> DataFrame:
    """Join candidates back to their chunks and questions.

    Where the questions fit one block (``bounded``), they bound the candidate list to that many times
    two lists of numbers; then the chunk table streams past both small sides and
    is never shuffled. A larger question table is joined by shuffle.
    """
    asked = questions.select("query_id", *question_columns)
    texts = chunks.select("id", *chunk_columns)
    if bounded:
        return texts.join(F.broadcast(candidates), "id").join(F.broadcast(asked), "query_id")
    return texts.join(candidates, "id").join(asked, "query_id")


def asked_lists(questions: DataFrame, terms: DataFrame, scope: str | None = None) -> DataFrame:
    """What one pass for both lists has to know of each question; a part that a question lacks is null."""
    vector = F.when(is_usable(F.col("query_vec")), F.col("query_vec").cast("array<double>")).alias("query_vec")
    tenant = [F.col("tenant_id")] if "tenant_id" in questions.columns else []
    asked = questions.select("query_id", vector, *tenant, *scoring.scoped(questions, scope), *scoring.permitted(questions))
    return asked.join(terms.select("query_id", "terms", "weights"), "query_id", "left")


def both_lists(asked: DataFrame, chunks: DataFrame, depth: int, *, source_too: bool = False, scope: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The semantic and the keyword list, ``(query_id, id, score, rank)`` each, from one pass over the chunks.

    Both are written at once: told apart in one plan, each would get a pass of its own.
    """
    tenant, chunks = scoring.one_tenant(asked, chunks)
    c = chunks.select("id", "embedding", is_usable(F.col("embedding")).alias("usable"), F.lower("content").alias("text"), *tenant,
                      *([F.lower("source").alias("source")] if source_too else []), *scoring.scoped(chunks, scope), *scoring.permitted(chunks))
    found = scoring.stored_lists([scoring.Ranking("semantic", scoring.VectorBlock, depth), scoring.Ranking("keyword", scoring.TermBlock, depth)], asked, c, **options)
    return tuple(found.filter(F.col("list") == name).drop("list") for name in ("semantic", "keyword"))


def fused_candidates(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    stopwords: list[str] = fixed.ROUTE_STOPWORDS,
    scope: str | None = None,
    depth: int = fixed.LIST_DEPTH,
    max_block: int = scoring.MAX_BLOCK,
) -> DataFrame:
    """Both lists, fused, with chunk columns and the similarity of every candidate.

    Lists carry ids and numbers only; texts join back for the few candidates.
    """
    asked = asked_lists(questions, coverage_terms(questions, stopwords), scope)
    block = scoring.bounded_block(asked, max_block)
    fused = fusion.rrf_fusion(*both_lists(asked, chunks, depth, scope=scope, max_block=max_block, block=block))
    columns = [c for c in ("source", "source_type", "location", "content", "category", "embedding") if c in chunks.columns]
    full = with_texts(fused, questions, chunks, columns, ["query", "query_vec", "top_k"], block is not None)
    return full.withColumn(
        "semantic_score", F.coalesce("sim", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6), F.lit(0.0))
    ).drop("sim", "embedding", "query_vec")


def keyword_topk_semtie(questions: DataFrame, chunks: DataFrame, k: int,
                        *, stopwords: list[str] = fixed.ROUTE_STOPWORDS, **options) -> DataFrame:
    """Keyword order in which equal scores are ordered by similarity, then id."""
    q = coverage_terms(questions, stopwords).join(
        questions.select("query_id", F.col("query_vec").cast("array<double>")), "query_id")
    c = valid_vectors(chunks).select("id", F.lower("content").alias("text"), "embedding")
    best = scoring.best_k(scoring.TermThenVectorBlock, q, c, k, **options)
    hits, similarity = scoring.TermThenVectorBlock.parts(F.col("score"))
    return best.join(q.select("query_id", F.size("terms").alias("n")), "query_id").select(
        "query_id", "id", F.round(hits / F.col("n"), 6).alias("kw_score"), similarity.alias("semantic_score"), "rank")


def search_documents(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    stopwords: list[str] = fixed.TOOL_STOPWORDS,
    scope: str | None = "category",
    floor: float = fixed.SIMILARITY_FLOOR,
    max_top_k: int = 20,
    max_block: int = scoring.MAX_BLOCK,
) -> DataFrame:
    """The search tool: fused and de-duplicated, guarded, best ``top_k`` per question."""
    if not {"tenant_id", "principals"} & {*questions.columns} and scoring.bounded_block(questions, max_block) is None:
        return search_many(questions, chunks, stopwords=stopwords, scope=scope, floor=floor, max_top_k=max_top_k, max_block=max_block)
    candidates = fusion.candidate_dedup(fused_candidates(
        questions, chunks, stopwords=stopwords, scope=scope, max_block=max_block))
    kept = fusion.similarity_guard(candidates, floor)
    return kept.filter(F.col("place") <= fusion.clamp(F.col("top_k"), 1, max_top_k)).select(
        "query_id", F.col("place").alias("rank"), "id", "source", "location", "content", "category",
        "semantic_score", F.col("rrf").alias("score"))


def search_many(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    stopwords: list[str] = fixed.TOOL_STOPWORDS,
    scope: str | None = "category",
    floor: float = fixed.SIMILARITY_FLOOR,
    max_top_k: int = 20,
    max_block: int = scoring.MAX_BLOCK,
) -> DataFrame:
    """:func:`search_documents` for more questions than a block holds, with the same rows.

    The lists are made apart, so that no text goes to the grid of questions and chunks. Candidates are ids and numbers with
    a digest of their text until they are cut; vectors meet what is left, and texts the answer only.
    """
    asked = questions.select("query_id", "query_vec", *([scope] if scope in questions.columns else []))
    semantic = persist_table(semantic_topk(asked, chunks, scope=scope, max_block=max_block, sample=0, slice_rows=VECTOR_ROWS), "semantic")
    texts = chunks.select("id", F.lower("content").alias("text"), *scoring.scoped(chunks, scope))
    keyword = keyword_topk_many(coverage_terms(questions, stopwords, scope), texts, max_block=max_block)
    fused = fusion.rrf_fusion(semantic, keyword).join(fusion.text_keys(chunks), "id")
    kept = persist_table(fusion.candidate_dedup(fused).select("query_id", "id", "place", "rrf", "sim"), "candidates")
    blind = kept.filter(F.col("sim").isNull()).join(chunks.select("id", "embedding"), "id").join(questions.select("query_id", "query_vec"), "query_id")
    seen = kept.filter(F.col("sim").isNotNull()).unionByName(
        blind.withColumn("sim", F.coalesce(F.round(cosine(F.col("embedding"), F.col("query_vec")), 6), F.lit(0.0))).select(*kept.columns))
    best = fusion.similarity_guard(seen.withColumnRenamed("sim", "semantic_score"), floor).join(questions.select("query_id", "top_k"), "query_id")
    best = best.filter(F.col("place") <= fusion.clamp(F.col("top_k"), 1, max_top_k))
    return chunks.select("id", "source", "location", "content", "category").join(best, "id").select(
        "query_id", F.col("place").alias("rank"), "id", "source", "location", "content", "category",
        "semantic_score", F.col("rrf").alias("score"))


def reranked_candidates(questions: DataFrame, chunks: DataFrame, *, scorer=None,
                        max_block: int = scoring.MAX_BLOCK) -> DataFrame:
    candidates = fusion.candidate_dedup(fused_candidates(valid_questions(questions), chunks, max_block=max_block))
    return fusion.rerank(candidates, scorer)


def hybrid_retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    scorer=None,
    floor: float = fixed.SIMILARITY_FLOOR,
    max_top_k: int = fixed.TOP_K,
    max_block: int = scoring.MAX_BLOCK,
) -> DataFrame:
    """The question route: fused, de-duplicated, reranked, boosted, guarded, best ``top_k``."""
    ranked = fusion.named_doc_boost(reranked_candidates(questions, chunks, scorer=scorer, max_block=max_block))
    kept = fusion.similarity_guard(ranked, floor)
    return kept.filter(F.col("place") <= fusion.clamp(F.col("top_k"), 1, max_top_k)).select(
        "query_id", F.col("place").alias("rank"), "id", "source", "source_type", "location", "content",
        "semantic_score", "score", "named")


def legacy_candidates(questions: DataFrame, chunks: DataFrame, *, max_block: int = scoring.MAX_BLOCK, index: Postings | None = None) -> DataFrame:
    """Rarity-weighted single-index search before the reranker: floors, fusion from 0.

    ``index``: stored postings, which give the rarity of the question words; without them, a pass over the texts counts it.
    """
    depth = chunks.select("id").limit(fixed.INDEX_LIST_DEPTH).count()
    asked = asked_lists(questions, idf_terms(questions, keyword_idf(questions, chunks, index=index)))
    semantic, keyword = both_lists(asked, chunks, max(depth, 1), source_too=True, max_block=max_block)
    return fusion.rrf_fusion_limited(semantic.filter(F.col("score") >= fixed.INDEX_SEM_FLOOR), keyword.filter("score > 0"), depth)


def legacy_retrieve(questions: DataFrame, chunks: DataFrame, *, scorer=None, top_k: int = fixed.TOP_K,
                    max_block: int = scoring.MAX_BLOCK, index: Postings | None = None) -> DataFrame:
    """One chunk per source, reranked, only positive scores, best ``top_k``."""
    fused = legacy_candidates(questions, chunks, max_block=max_block, index=index)
    bounded = scoring.bounded_block(questions.select("query_id", "query"), max_block) is not None
    full = with_texts(fused, questions, chunks, ["source", "source_type", "location", "content"], ["query"], bounded)
    ranked = fusion.rerank(fusion.source_dedup(full), scorer).filter(F.col("score") > 0)
    return ranked.filter(F.col("place") <= top_k).select(
        "query_id", F.col("place").alias("rank"), "id", "source", "source_type", "location", "content")


def context_pack(retrieved: DataFrame) -> DataFrame:
    """One prompt context per question; each chunk gets its share of the budget."""
    per_query = Window.partitionBy("query_id")
    n = F.count("*").over(per_query)
    share = F.greatest(F.lit(fixed.CONTEXT_MIN), F.floor(F.lit(fixed.CONTEXT_BUDGET) / n))
    limit = F.least(F.lit(fixed.CONTEXT_MAX), share).cast("int")

    def entry() -> Column:
        return F.concat(
            F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("source"), F.lit(" | Location: "),
            F.col("location"), F.lit("\n"), F.col("piece"), F.lit("\n\n"))

    return (
        retrieved.withColumn("limit", limit)
        .withColumn("piece", truncate(F.col("content"), F.col("limit")))
        .withColumn("entry", entry())
        .groupBy("query_id")
        .agg(F.count("*").alias("n_chunks"),
             F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "")
             .alias("context")))


def history_tail(turns: DataFrame, keep: int = fixed.HISTORY_TURNS) -> DataFrame:
    """Last turns of every conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")
