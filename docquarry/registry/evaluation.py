"""Registered queries: answer scoring and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions import text as tx
from docquarry.operators import evaluation as ev
from docquarry.operators.keyword import containment_pairs, keyword_topk
from docquarry.operators.semantic import semantic_topk
from docquarry.registry.retrieval import _kw_sql, _kwlist_sql, _sem_sql
from docquarry.registry.texts import _CITE_PARTS, SPECIFIC_RX, TRIM, WS, _ascii, qt, sql_refused
from docquarry.registry.views import answers, index_chunks, questions, table, with_answers, with_index

_SKILL = {
    "name": "concat('finding-doc-', CAST(doc_id AS VARCHAR(20)), '.md')",
    "text": "concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(' T', CAST(1000 + doc_id % 900 AS VARCHAR(20)), '.001 and AML.T', "
            "CAST(doc_id % 50 AS VARCHAR(20)), ' then T1003.') ELSE '' END)",
}
_SKILLS = [f"{e} AS {c}" for c, e in _SKILL.items()]


def q_gen_questions(s, d):
    g = ev.gen_questions(table(s, d, "documents").selectExpr(*_SKILLS))
    return g.select("category", "q", "expected_source", "expected_token", F.array_join("tokens", ",").alias("tokens"))


_EVAL = {
    "category": "CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN 'HIT' WHEN 1 THEN 'REFUSE' WHEN 2 THEN 'TRAP' ELSE 'MERGE' END",
    "e1": "concat('doc-', CAST(conv_id AS VARCHAR(20)))",
    "e2": "concat('doc-', CAST(turn AS VARCHAR(20)), '.md')",
    # every other question names the specifics that its answer may repeat
    "question": "CASE WHEN conv_id % 3 = 0 THEN concat(question, ' T1059.001 2019 2024 $4.8 M') ELSE question END",
    "context": "CASE WHEN conv_id % 5 = 0 THEN concat(question, ' 2025 2024 CVE-2024-', CAST(1000 + conv_id AS VARCHAR(20)), ' $4.8 m') ELSE question END",
}


def _evaluated(s, d) -> DataFrame:
    a = answers(s, d).selectExpr("answer_id", "answer", *[f"{e} AS {c}" for c, e in _EVAL.items()])
    return a.withColumn("expected_sources", F.array("e1", "e2")).withColumn("citations", tx.citations(F.col("answer"))).withColumn(
        "expected_sources", F.when(F.col("category") == "MERGE", F.col("expected_sources")).otherwise(F.array("e1")))


def q_unsupported_specifics(s, d):
    a = _evaluated(s, d)
    return a.select("answer_id", F.array_join(
        tx.unsupported_specifics(F.col("answer"), F.col("context"), F.col("question")), "|").alias("invented"))


def q_score_answers(s, d):
    return ev.score_answers(_evaluated(s, d)).select("answer_id", "category", "ok", "retrieval_hit", "reason")


def q_eval_rates(s, d):
    return ev.eval_rates(ev.score_answers(_evaluated(s, d)))


def q_golden_checks(s, d):
    a = _evaluated(s, d).select(
        "answer_id", "answer", F.array(F.lit("2024"), F.lit("LABS"), F.lit("cve")).alias("must_contain_any"),
        F.array("e1").alias("must_cite_any"), F.array(F.lit("$4.8 m"), F.lit("2019-05")).alias("must_not_contain"))
    return ev.golden_checks(a).select("answer_id", "has_fact", "has_source", "clean", "ok")


def _qrels(s, d) -> DataFrame:
    """Documents that hold a benchmark text in full."""
    b = table(s, d, "benchmark")
    return containment_pairs(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")), table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def q_qrels(s, d):
    return _qrels(s, d)


def q_retrieval_metrics(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    runs = keyword_topk(q, c, 10).select(F.lit("keyword").alias("run"), "query_id", F.col("id").alias("doc"), "rank").unionByName(
        semantic_topk(q, c, 10).select(F.lit("semantic").alias("run"), "query_id", F.col("id").alias("doc"), "rank"))
    rel = _qrels(s, d).select("query_id", F.col("id").alias("doc"))
    judged = rel.withColumn("run", F.explode(F.array(F.lit("keyword"), F.lit("semantic"))))
    return ev.retrieval_metrics(runs, judged, ["run"])


def q_recall_delta(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    docs = c.select(F.col("id").alias("doc"), F.col("tenant_id").alias("source"))
    rel = _qrels(s, d).select("query_id", F.col("id").alias("doc")).join(docs, "doc")
    alone = None
    for tenant in ("tenant-a", "tenant-b"):
        part = keyword_topk(q, c.filter(F.col("tenant_id") == tenant), 10).select(
            F.lit("isolated").alias("run"), F.lit(tenant).alias("source"), "query_id", F.col("id").alias("doc"), "rank")
        alone = part if alone is None else alone.unionByName(part)
    both = keyword_topk(q, c, 10).select(F.lit("combined").alias("run"), "query_id", F.col("id").alias("doc"), "rank")
    both = both.join(docs, "doc").select("run", "source", "query_id", "doc", "rank")
    judged = rel.withColumn("run", F.explode(F.array(F.lit("isolated"), F.lit("combined"))))
    return ev.recall_delta(ev.retrieval_metrics(alone.unionByName(both), judged, ["run", "source"]))


def q_latency_percentiles(s, d):
    return ev.latency_percentiles(table(s, d, "events").selectExpr("event_type AS stage", "value AS ms"), "stage")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_EV_SQL = with_answers(
    ", ev AS (SELECT answer_id, answer, " + ", ".join(f"{e} AS {c}" for c, e in _EVAL.items()) + " FROM answers), "
    f"ev2 AS (SELECT *, CASE category WHEN 'MERGE' THEN [e1, e2] ELSE [e1] END AS expected, "
    f"regexp_extract_all(answer, {qt(_CITE_PARTS)}, 1) AS cites, regexp_extract_all(answer, {qt(f'(?i)[[]Citation:{WS}*([^]|,]+)')}, 1) AS names, "
    f"list_filter(regexp_extract_all({_ascii('answer')}, {qt(SPECIFIC_RX)}), lambda t: NOT contains(lower(question), lower(t)) AND NOT contains(lower(context), lower(t))) AS invented, "
    f"(trim(answer, {TRIM}) = '' OR regexp_matches(answer, {qt('(?i)' + fixed.EVAL_REFUSAL_PATTERN)}) OR (len(regexp_extract_all(answer, {qt(_CITE_PARTS)})) = 0 "
    f"AND regexp_matches(answer, {qt('(?i)' + fixed.EVAL_HEDGE_PATTERN)}))) AS refused FROM ev), "
    "ev3 AS (SELECT *, len(list_filter(expected, lambda e: len(list_filter(list_concat(cites, names), lambda c: contains(lower(c), lower(e)))) > 0)) AS n_cited FROM ev2), "
    "sc AS (SELECT *, n_cited > 0 AS retrieval_hit, CASE category WHEN 'HIT' THEN refused OR len(cites) > 0 OR regexp_matches(answer, '(?i)[[]Citation:') "
    "WHEN 'REFUSE' THEN refused WHEN 'TRAP' THEN refused OR len(invented) = 0 ELSE n_cited = len(expected) END AS ok, "
    "CASE WHEN category <> 'MERGE' AND refused THEN 'refused' WHEN category = 'HIT' THEN CASE WHEN n_cited > 0 THEN 'cited expected source' ELSE 'cited other source' END "
    "WHEN category = 'REFUSE' THEN 'answered' WHEN category = 'TRAP' THEN CASE WHEN len(invented) > 0 THEN 'invented specifics' ELSE 'supported' END "
    "ELSE 'cited ' || n_cited || '/' || len(expected) END AS reason FROM ev3)"
)
_REL = "rel AS (SELECT b.item_id AS query_id, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = (
    "per AS (SELECT {by}, j.query_id, count(*) AS n_rel, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in (1, 3, 5, 10))
    + ", min(rank) AS first, coalesce(sum(1.0::DOUBLE / log2(rank + 1.0)) FILTER (rank <= 10), 0) AS dcg FROM judged j LEFT JOIN runs r "
    "USING ({using}, query_id, doc) GROUP BY ALL), "
    "ideal AS (SELECT *, list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0))) AS ideal FROM per), "
    "met AS (SELECT {using}, count(*) AS n_queries, " + ", ".join(f"round(avg(h{k}::DOUBLE / n_rel), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", "
    + ", ".join(f"round(avg(h{k} / {k}.0::DOUBLE), 6) AS precision_{k}" for k in (3, 5, 10))
    + ", round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg_10, "
    + ", ".join(f"round(avg((h{k} > 0)::INT), 6) AS hit_{k}" for k in (1, 3, 5)) + " FROM ideal GROUP BY ALL)"
)

ORACLES = {
    "gen_questions": (
        f"WITH s AS (SELECT {', '.join(_SKILLS)} FROM documents), t AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(text, "
        f"{qt('(?:' + fixed.TECHNIQUE_PATTERN + ')')}), lambda x: length(x) >= 5))) AS tokens FROM s) "
        "SELECT 'HIT' AS category, 'Which MITRE technique does the ''' || trim(replace(replace(name, '-', ' '), '.md', '')) || ''' skill address?' AS q, "
        "name AS expected_source, tokens[1] AS expected_token, array_to_string(tokens, ',') AS tokens FROM t WHERE len(tokens) > 0 ORDER BY name LIMIT 30"),
    "unsupported_specifics": _EV_SQL + " SELECT answer_id, array_to_string(invented, '|') AS invented FROM sc",
    "score_answers": _EV_SQL + " SELECT answer_id, category, ok, retrieval_hit, reason FROM sc",
    "eval_rates": _EV_SQL + (
        " SELECT coalesce(category, 'total') AS category, count(*) FILTER (ok) AS passed, count(*) AS total, round(100.0::DOUBLE * avg(ok::INT), 4) AS rate, "
        "round(100.0::DOUBLE * avg(CASE WHEN category = 'HIT' THEN retrieval_hit::INT END), 4) AS hit_rate FROM sc GROUP BY ROLLUP (category)"),
    "golden_checks": _EV_SQL + (
        f", g AS (SELECT answer_id, {sql_refused('answer')} AS rf, lower(answer) AS a, answer, e1 FROM ev) "
        "SELECT answer_id, rf OR contains(a, '2024') OR contains(a, 'labs') OR contains(a, 'cve') AS has_fact, rf OR contains(answer, e1) AS has_source, "
        "NOT (contains(a, '$4.8 m') OR contains(a, '2019-05')) AS clean, has_fact AND has_source AND clean AS ok FROM g"),
    "qrels": "SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "retrieval_metrics": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_sem_sql(10)}, {_kwlist_sql(10)}, {_REL}, "
        "runs AS (SELECT 'keyword' AS run, query_id, id AS doc, rank FROM kwl UNION ALL SELECT 'semantic', query_id, id, rank FROM sem), "
        "judged AS (SELECT run, query_id, doc FROM rel, (VALUES ('keyword'), ('semantic')) v(run)), "
        + _METRICS.format(by="j.run", using="run") + " SELECT * FROM met"),
    "recall_delta": with_index(
        f", {_kw_sql(fixed.ROUTE_STOPWORDS)}, {_kwlist_sql(10)}, {_REL}, t AS (SELECT id AS doc, tenant_id AS source FROM idx), "
        "iso AS (SELECT k.query_id, k.id AS doc, t.source, row_number() OVER (PARTITION BY k.query_id, t.source ORDER BY k.score DESC, k.id) AS rank "
        "FROM kwl_all k JOIN t ON t.doc = k.id QUALIFY rank <= 10), "
        "runs AS (SELECT 'isolated' AS run, source, query_id, doc, rank FROM iso UNION ALL SELECT 'combined', source, query_id, id, rank FROM kwl JOIN t ON t.doc = id), "
        "judged AS (SELECT run, source, query_id, doc FROM rel JOIN t USING (doc), (VALUES ('isolated'), ('combined')) v(run)), "
        + _METRICS.format(by="j.run, j.source", using="run, source")
        + ", w AS (SELECT source, max(recall_10) FILTER (run = 'isolated') AS isolated, max(recall_10) FILTER (run = 'combined') AS combined FROM met GROUP BY source) "
        "SELECT *, round(combined - isolated, 6) AS delta FROM w"),
    "latency_percentiles": "SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1",
}
