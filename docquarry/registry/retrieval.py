"""Registered queries: scoring, fusion, retrieval, evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions.vectors import cosine
from docquarry.operators import fusion
from docquarry.operators.catalog import with_grants, with_principals
from docquarry.operators.keyword import (
    keyword_coverage, keyword_idf, keyword_idf_topk, keyword_topk, query_keywords,
)
from docquarry.operators.buckets import semantic_topk_buckets
from docquarry.operators.semantic import recall_of, semantic_top1, semantic_topk, valid_vectors
from docquarry.plans import retrieve
from docquarry.registry.views import index_buckets, index_chunks, index_postings, questions, table, with_index
from docquarry.session import persist_table


def _in_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _kw_sql(words: list[str]) -> str:
    return (
        "kw AS (SELECT *, list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'), "
        f"lambda x: NOT list_contains({_in_list(words)}, x)) AS keywords FROM questions)"
    )


# whom a question's user may read: questions of ann, of bob and of nobody
_USER = "CASE CAST(query_id % 3 AS INT) WHEN 0 THEN 'ann@acme.org' WHEN 1 THEN 'bob@other.org' END"
ACL = {
    "visibility": "CASE WHEN doc_id % 5 = 0 THEN 'public' WHEN doc_id % 5 < 4 THEN 'team' END",
    "users": "CASE WHEN toxic = 1 THEN {a}'ann@acme.org', {z}source{y} WHEN toxic = 0 THEN {a}{z}source{y} END",
    "groups": "CASE WHEN quality = 1 THEN {a}'acme.org'{y} ELSE {a}'other.org'{y} END",
}
_ACL_SQL = (
    "acl AS (SELECT doc_id AS id, " + ", ".join(f"{e.format(a='[', y=']', z='')} AS \"{c}\"" for c, e in ACL.items()) + " FROM documents LEFT JOIN labels USING (doc_id)), "
    f"asker AS (SELECT query_id, {_USER} AS who FROM questions), "
    "see AS (SELECT query_id, id FROM asker CROSS JOIN acl WHERE coalesce(visibility, 'public') = 'public' OR coalesce(list_contains(users, who), FALSE) "
    "OR coalesce(list_contains(groups, regexp_extract(who, '[^@]*$')), FALSE))"
)
_SEEN = "EXISTS (FROM see WHERE see.query_id = q.query_id AND see.id = c.id)"


def _sem_sql(depth: int, scoped: bool = False, acl: bool = False) -> str:
    where = f"WHERE {_SEEN} " if acl else "WHERE q.category IS NULL OR q.category = c.category " if scoped else ""
    return (
        "sem_all AS (SELECT q.query_id, c.id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), "
        f"CAST(q.query_vec AS DOUBLE[])), 6) AS score FROM questions q CROSS JOIN idx c {where}), "
        "sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sem_all "
        f"QUALIFY rank <= {depth})"
    )


def _kwlist_sql(depth: int, scoped: bool = False, acl: bool = False) -> str:
    where = f"AND {_SEEN} " if acl else "AND (q.category IS NULL OR q.category = c.category) " if scoped else ""
    return (
        "low AS MATERIALIZED (SELECT id, category, lower(content) AS text FROM idx), "
        "hit AS MATERIALIZED (SELECT w.word, low.id FROM (SELECT DISTINCT unnest(keywords) AS word FROM kw) w "
        "JOIN low ON contains(low.text, w.word)), "
        "qw AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(keywords) AS word FROM kw) GROUP BY ALL), "
        "kwl_hit AS (SELECT query_id, id, sum(times) AS n FROM qw JOIN hit USING (word) GROUP BY ALL), "
        "kwl_all AS (SELECT q.query_id, c.id, coalesce(h.n, 0)::DOUBLE / len(q.keywords) AS score FROM kw q CROSS JOIN "
        "low c LEFT JOIN kwl_hit h ON h.query_id = q.query_id AND h.id = c.id "
        f"WHERE len(q.keywords) > 0 {where}), "
        "kwl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kwl_all "
        f"QUALIFY rank <= {depth})"
    )


_FUSED_SQL = (
    "fused AS (SELECT query_id, id, max(s) AS sem_rank, max(k) AS kw_rank, "
    "coalesce(1.0::DOUBLE / (60 + max(s)), 0) + coalesce(1.0::DOUBLE / (60 + max(k)), 0) AS rrf FROM ("
    "SELECT query_id, id, rank AS s, NULL AS k FROM sem UNION ALL SELECT query_id, id, NULL, rank FROM kwl) GROUP BY ALL)"
)
_FULL_SQL = (
    "full_c AS (SELECT f.*, q.query, q.top_k, c.source, c.source_type, c.location, c.content, c.category, a.score AS semantic_score, "
    "substr(lower(trim(c.content, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')), 1, 200) AS dkey "
    "FROM fused f JOIN questions q USING (query_id) JOIN idx c USING (id) JOIN sem_all a USING (query_id, id))"
)
_DEDUP_SQL = (
    "one AS (SELECT * FROM full_c WHERE dkey <> '' QUALIFY row_number() OVER (PARTITION BY query_id, dkey "
    "ORDER BY rrf DESC, id) = 1), "
    "cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place FROM one QUALIFY place <= 20)"
)


def _base(words: list[str], scoped: bool = False, acl: bool = False) -> str:
    return ", ".join([*([_ACL_SQL] if acl else []), _kw_sql(words), _sem_sql(60, scoped, acl), _kwlist_sql(60, scoped, acl), _FUSED_SQL])


_CAND = f"{_base(fixed.ROUTE_STOPWORDS)}, {_FULL_SQL}, {_DEDUP_SQL}"
_LEX_SQL = (
    "terms AS (SELECT query_id, list_distinct(keywords) AS terms FROM kw), "
    "tok AS (SELECT c.*, t.terms, regexp_extract_all(lower(substr(c.content, 1, 512)), '[\\p{L}\\p{N}_]+') AS toks "
    "FROM %s c JOIN terms t USING (query_id)), "
    "lex AS (SELECT * EXCLUDE (terms, toks), CASE WHEN len(terms) = 0 OR len(toks) = 0 THEN 0.0::DOUBLE ELSE "
    "round(len(list_intersect(terms, toks))::DOUBLE / len(terms) + "
    "len(list_filter(toks, lambda x: list_contains(terms, x)))::DOUBLE / len(toks), 6) END AS score FROM tok), "
    "rer AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS place FROM lex)"
)
_STEM = "lower(regexp_replace(regexp_extract(source, '[^/]*$'), '^(\\.*[^.].*)\\.[^.]*$', '\\1'))"
_BOOST_SQL = (
    "boo AS (SELECT * EXCLUDE (score, place), score + CASE WHEN named THEN 5.0 ELSE 0.0 END AS score, place AS before FROM ("
    f"SELECT *, {_STEM} <> '' AND (contains(lower(query), {_STEM}) OR contains("
    f"regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'), regexp_replace({_STEM}, '[^a-z0-9]+', ' ', 'g'))) AS named FROM rer)), "
    "boosted AS (SELECT * EXCLUDE (before), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS place FROM boo)"
)
_GUARD = "QUALIFY max(semantic_score) OVER (PARTITION BY query_id) >= 0.40"
HYBRID_SQL = (
    f"{_CAND}, {_LEX_SQL % 'cand'}, {_BOOST_SQL}, guarded AS (SELECT * FROM boosted {_GUARD}), "
    "hybrid AS (SELECT *, place AS rank FROM guarded WHERE place <= greatest(1, least(top_k, 8)))"
)

_IDF_SQL = (
    _kw_sql(fixed.INDEX_STOPWORDS) + ", "
    "w AS (SELECT DISTINCT query_id, unnest(keywords) AS word FROM kw), "
    "low AS MATERIALIZED (SELECT id, lower(content) AS text, lower(source) AS src FROM idx), "
    "hit AS MATERIALIZED (SELECT d.word, low.id FROM (SELECT DISTINCT word FROM w) d JOIN low "
    "ON contains(low.text, d.word) OR contains(low.src, d.word)), "
    "idf AS MATERIALIZED (SELECT d.word, count(h.id) AS df, (SELECT count(*) FROM idx) AS n FROM (SELECT DISTINCT word FROM w) d "
    "LEFT JOIN hit h USING (word) GROUP BY d.word), "
    "idfs AS MATERIALIZED (SELECT *, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM idf), "
    "stok AS (SELECT DISTINCT src, unnest(regexp_extract_all(src, '[\\p{L}\\p{N}_]+')) AS t FROM low), "
    "phit AS (SELECT DISTINCT i.word, s.src FROM idfs i JOIN stok s ON length(s.t) >= 3 "
    "AND (starts_with(i.word, s.t) OR starts_with(s.t, i.word))), "
    "anyhit AS MATERIALIZED (SELECT word, id FROM hit UNION SELECT p.word, low.id FROM phit p JOIN low USING (src)), "
    "tot AS (SELECT query_id, sum(idf) AS total FROM w JOIN idfs USING (word) GROUP BY query_id), "
    "ks AS (SELECT w.query_id, a.id, round(sum(i.idf) / any_value(tot.total), 9) AS score FROM w JOIN idfs i USING (word) "
    "JOIN anyhit a USING (word) JOIN tot USING (query_id) GROUP BY w.query_id, a.id), "
    "kwl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ks "
    "WHERE score > 0 QUALIFY rank <= 100)"
)
_LEGACY_SQL = (
    _IDF_SQL + ", " + _sem_sql(100) + ", lim AS (SELECT least(100, count(*)) AS n FROM idx), "
    "fused AS (SELECT query_id, id, max(s) AS sem_rank, max(k) AS kw_rank, "
    "1.0::DOUBLE / (60 + coalesce(max(s) - 1, any_value(lim.n))) + 1.0::DOUBLE / (60 + coalesce(max(k) - 1, any_value(lim.n))) AS rrf "
    "FROM (SELECT query_id, id, rank AS s, NULL AS k FROM sem WHERE score >= 0.10 UNION ALL "
    "SELECT query_id, id, NULL, rank FROM kwl) CROSS JOIN lim GROUP BY query_id, id)"
)
_SRC_DEDUP_SQL = (
    "fulls AS (SELECT f.*, q.query, c.source, c.source_type, c.location, c.content FROM fused f JOIN questions q USING (query_id) "
    "JOIN idx c USING (id)), "
    "ones AS (SELECT * FROM fulls QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rrf DESC, id) = 1), "
    "scand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place FROM ones QUALIFY place <= 20)"
)

_QRELS_SQL = "qrels AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


# --- queries -----------------------------------------------------------------------------

def q_query_keywords(s: SparkSession, d: str) -> DataFrame:
    q = query_keywords(questions(s, d))
    return q.select("query_id", F.array_join("keywords", " ").alias("keywords"), F.size("keywords").alias("n"))


def q_semantic_topk(s, d):
    return semantic_topk(questions(s, d), index_chunks(s, d))


def q_semantic_top1(s, d):
    return semantic_top1(questions(s, d), index_chunks(s, d))


def q_semantic_topk_lsh(s, d):
    return semantic_topk_buckets(questions(s, d), *index_buckets(s, d))


def q_lsh_recall(s, d):
    exact = semantic_topk(questions(s, d), index_chunks(s, d))
    recall = recall_of(q_semantic_topk_lsh(s, d), exact)
    reached = recall.agg(F.avg("recall") >= 0.9).scalar()
    return exact.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("reached", reached)


def q_cosine_scores(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    pairs = keyword_topk(q, c).select("query_id", "id")
    full = retrieve.with_texts(pairs, q, c, ["embedding"], ["query_vec"], True)
    return full.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6).alias("cosine"))


def q_valid_vectors(s, d):
    e = table(s, d, "embeddings").withColumn(
        "embedding", F.when(F.col("label") % 3 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return valid_vectors(e).groupBy("label").agg(F.count("*").alias("n"))


def q_keyword_topk(s, d):
    return keyword_topk(questions(s, d), index_chunks(s, d)).withColumn("score", F.round("score", 6))


def q_keyword_scores(s, d):
    return keyword_coverage(questions(s, d), index_chunks(s, d))


def q_keyword_topk_semtie(s, d):
    return retrieve.keyword_topk_semtie(questions(s, d), index_chunks(s, d), 10)


def q_keyword_idf(s, d):
    return keyword_idf(questions(s, d), index_chunks(s, d)).select("word", "df", "n", F.round("idf", 6).alias("idf"))


def q_keyword_idf_scores(s, d):
    return keyword_idf_topk(questions(s, d), index_chunks(s, d)).withColumn("score", F.round("score", 6))


def q_token_postings(s, d):
    return index_postings(s, d).tokens.groupBy("token", "in_name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def q_rrf_fusion(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    return fusion.rrf_fusion(semantic_topk(q, c), keyword_topk(q, c)).select(
        "query_id", "id", "sem_rank", "kw_rank", F.round("rrf", 9).alias("rrf"))


def q_rrf_fusion_legacy(s, d):
    return retrieve.legacy_candidates(questions(s, d), index_chunks(s, d)).select(
        "query_id", "id", F.round("rrf", 9).alias("rrf"))


def q_candidate_dedup(s, d):
    c = fusion.candidate_dedup(retrieve.fused_candidates(questions(s, d), index_chunks(s, d)))
    return c.select("query_id", "id", "place", F.round("rrf", 9).alias("rrf"))


def q_source_dedup(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    full = retrieve.with_texts(retrieve.legacy_candidates(q, c), q, c, ["source"], [], True)
    return fusion.source_dedup(full).select("query_id", "id", "source", "place", F.round("rrf", 9).alias("rrf"))


def q_rerank_topk(s, d):
    return retrieve.reranked_candidates(questions(s, d), index_chunks(s, d)).select("query_id", "id", "place", "score")


def q_named_doc_boost(s, d):
    r = fusion.named_doc_boost(retrieve.reranked_candidates(questions(s, d), index_chunks(s, d)))
    return r.select("query_id", "id", "place", "named", F.round("score", 6).alias("score"))


def q_similarity_guard(s, d):
    c = fusion.candidate_dedup(retrieve.fused_candidates(questions(s, d), index_chunks(s, d)))
    return fusion.similarity_guard(c).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("semantic_score").alias("best"))


def q_search_documents(s, d):
    return retrieve.search_documents(questions(s, d), index_chunks(s, d)).select(
        "query_id", "rank", "id", "source", "location", "category", "semantic_score", F.round("score", 9).alias("score"))


def q_hybrid_retrieve(s, d):
    return retrieve.hybrid_retrieve(questions(s, d), index_chunks(s, d)).select(
        "query_id", "rank", "id", "source", "location", "semantic_score", F.round("score", 6).alias("score"))


def q_hybrid_retrieve_acl(s, d):
    """Every question's user sees only chunks that their permissions allow, before anything is scored."""
    shared = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").selectExpr(
        "doc_id AS id", *[f"{e.format(a='array(', y=')', z='')} AS `{c}`" for c, e in ACL.items()])
    # stored once: the passes and the last join would each shuffle all texts to their permissions again
    c = persist_table(with_grants(index_chunks(s, d).join(shared, "id")), "granted")
    q = with_principals(questions(s, d).withColumn("user", F.expr(_USER)))
    return retrieve.hybrid_retrieve(q, c).select(
        "query_id", "rank", "id", "source", "location", "semantic_score", F.round("score", 6).alias("score"))


def q_legacy_retrieve(s, d):
    return retrieve.legacy_retrieve(questions(s, d), index_chunks(s, d)).select(
        "query_id", "rank", "id", "source", "location")


def q_context_pack(s, d):
    return retrieve.context_pack(retrieve.hybrid_retrieve(questions(s, d), index_chunks(s, d)))


def q_history_tail(s, d):
    return retrieve.history_tail(table(s, d, "conversations"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

ORACLES = {
    "query_keywords": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)} SELECT query_id, array_to_string(keywords, ' ') AS keywords, len(keywords) AS n FROM kw"),
    "semantic_topk": with_index(f", {_sem_sql(60)} SELECT query_id, id, score, rank FROM sem"),
    # found lists depend on the random projections; what SQL can say is how many there are to find, and that 0.9 of them are
    "lsh_recall": with_index(f", {_sem_sql(60)} SELECT query_id, count(*) AS n, TRUE AS reached FROM sem GROUP BY query_id"),
    "semantic_top1": with_index(f", {_sem_sql(1)} SELECT query_id, id, score FROM sem"),
    "cosine_scores": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_sem_sql(60)}, {_kwlist_sql(60)} "
        "SELECT query_id, id, a.score AS cosine FROM kwl JOIN sem_all a USING (query_id, id)"),
    "valid_vectors": "SELECT label, count(*) AS n FROM embeddings WHERE label % 3 <> 0 AND "
                     "len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label",
    "keyword_topk": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_kwlist_sql(60)} SELECT query_id, id, round(score, 6) AS score, rank FROM kwl"),
    "keyword_scores": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_kwlist_sql(60)} SELECT query_id, count(*) FILTER (score > 0) AS n_hit, "
        "round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM kwl_all GROUP BY query_id"),
    "keyword_topk_semtie": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_sem_sql(60)}, {_kwlist_sql(60)} "
        "SELECT query_id, id, round(k.score, 6) AS kw_score, a.score AS semantic_score, "
        "row_number() OVER (PARTITION BY query_id ORDER BY k.score DESC, a.score DESC, id) AS rank "
        "FROM kwl_all k JOIN sem_all a USING (query_id, id) QUALIFY rank <= 10"),
    "token_postings": with_index(
        ", t AS (SELECT DISTINCT id, FALSE AS in_name, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS token FROM idx UNION ALL "
        "SELECT DISTINCT id, TRUE, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}_]+')) FROM idx) "
        "SELECT token, in_name, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY ALL"),
    "keyword_idf": with_index(f", {_IDF_SQL} SELECT word, df, n, round(idf, 6) AS idf FROM idfs"),
    "keyword_idf_scores": with_index(f", {_IDF_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM kwl"),
    "rrf_fusion": with_index(
        f", {_base(fixed.ROUTE_STOPWORDS)} SELECT query_id, id, sem_rank, kw_rank, round(rrf, 9) AS rrf FROM fused"),
    "rrf_fusion_legacy": with_index(f", {_LEGACY_SQL} SELECT query_id, id, round(rrf, 9) AS rrf FROM fused"),
    "candidate_dedup": with_index(f", {_CAND} SELECT query_id, id, place, round(rrf, 9) AS rrf FROM cand"),
    "source_dedup": with_index(
        f", {_LEGACY_SQL}, {_SRC_DEDUP_SQL} SELECT query_id, id, source, place, round(rrf, 9) AS rrf FROM scand"),
    "rerank_topk": with_index(f", {_CAND}, {_LEX_SQL % 'cand'} SELECT query_id, id, place, score FROM rer"),
    "named_doc_boost": with_index(
        f", {_CAND}, {_LEX_SQL % 'cand'}, {_BOOST_SQL} SELECT query_id, id, place, named, round(score, 6) AS score FROM boosted"),
    "similarity_guard": with_index(
        f", {_CAND}, g AS (SELECT * FROM cand {_GUARD}) SELECT query_id, count(*) AS n, max(semantic_score) AS best FROM g GROUP BY query_id"),
    "search_documents": with_index(
        f", {_base(fixed.TOOL_STOPWORDS, True)}, {_FULL_SQL}, {_DEDUP_SQL}, g AS (SELECT * FROM cand {_GUARD}) "
        "SELECT query_id, place AS rank, id, source, location, category, semantic_score, round(rrf, 9) AS score FROM g "
        "WHERE place <= greatest(1, least(top_k, 20))"),
    "hybrid_retrieve": with_index(
        f", {HYBRID_SQL} SELECT query_id, rank, id, source, location, semantic_score, round(score, 6) AS score FROM hybrid"),
    "hybrid_retrieve_acl": with_index(
        f", {HYBRID_SQL.replace(_base(fixed.ROUTE_STOPWORDS), _base(fixed.ROUTE_STOPWORDS, acl=True))} "
        "SELECT query_id, rank, id, source, location, semantic_score, round(score, 6) AS score FROM hybrid"),
    "legacy_retrieve": with_index(
        f", {_LEGACY_SQL}, {_SRC_DEDUP_SQL}, {_LEX_SQL.replace('FROM kw)', 'FROM kwr)') % 'scand'} "
        "SELECT query_id, place AS rank, id, source, location FROM rer WHERE score > 0 AND place <= 8").replace(
            "terms AS (", _kw_sql(fixed.ROUTE_STOPWORDS).replace("kw AS", "kwr AS") + ", terms AS (", 1),
    "context_pack": with_index(
        f", {HYBRID_SQL}, s AS (SELECT *, least(700, greatest(250, 5600 // count(*) OVER (PARTITION BY query_id))) AS lim FROM hybrid) "
        "SELECT query_id, count(*) AS n_chunks, string_agg('[' || rank || '] Source: ' || source || ' | Location: ' || location || chr(10) || "
        "CASE WHEN length(content) > lim THEN substr(content, 1, lim) || '…' ELSE content END || chr(10) || chr(10), '' ORDER BY rank) AS context "
        "FROM s GROUP BY query_id"),
    "history_tail": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
}
