"""Registered queries: sentence and claim checks, evidence, final answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions import text as tx
from docquarry.operators import grounding as gr
from docquarry.plans import answer, retrieve
from docquarry.registry.retrieval import HYBRID_SQL
from docquarry.registry.texts import (
    _CITE_PARTS, _CITE_RX, _ENDNOTES_SQL, NWS, WCH, WS, _ascii, qt, sql_claims, sql_refused, sql_sentences, sql_strip,
)
from docquarry.registry.views import answers, evidence, index_chunks, questions, table, with_answers, with_index

_MEDIA = (
    "CASE WHEN rank = 1 THEN concat('multimedia/shot-', CAST(answer_id % 5 AS VARCHAR(20)), '.png') "
    "WHEN rank = 2 AND CAST(floor(answer_id / 1000) AS BIGINT) % 2 = 0 THEN concat('multimedia/shot-', CAST(answer_id % 5 AS VARCHAR(20)), '.md') "
    "ELSE source END"
)


def _media(s, d):
    return evidence(s, d).withColumn("source", F.expr(_MEDIA))


def q_citation_match(s, d):
    return gr.citation_match(answers(s, d), evidence(s, d))


def q_sentence_support(s, d):
    return gr.sentence_support(answers(s, d), evidence(s, d))


def q_auto_cite(s, d):
    return gr.auto_cite(answers(s, d), evidence(s, d)).select("answer_id", "pos", "source", "location")


def q_ground_labels(s, d):
    return gr.ground_sentences(answers(s, d), evidence(s, d))


def q_ground_answers(s, d):
    return gr.ground_answers(answers(s, d), evidence(s, d)).select("answer_id", "grounded")


def q_sidecar_evidence(s, d):
    return gr.sidecar_evidence(_media(s, d)).select("answer_id", "rank", "source")


def q_evidence_context(s, d):
    return gr.evidence_context(_media(s, d)).select("answer_id", F.length("context").alias("n"), F.md5("context").alias("context"))


def q_claim_support(s, d):
    a = answers(s, d).join(gr.evidence_context(evidence(s, d)), "answer_id", "left").withColumn("ctx", tx.comparable(F.coalesce("context", F.lit(""))))
    c = tx.unroll(a, tx.claims(F.col("answer")), "pos", "claim", ["answer_id", "ctx"])
    return c.select("answer_id", "pos", "claim", tx.claim_supported(F.col("claim"), F.col("ctx"), True).alias("supported"))


def q_grounding_check(s, d):
    a = answers(s, d).withColumn("context", F.when(F.col("conv_id") % 10 == 3, F.lit(" ")).otherwise(F.col("question")))
    return gr.grounding_check(a).select("answer_id", "ok", F.array_join("unsupported", "|").alias("unsupported"))


def q_guarded_answers(s, d):
    g = gr.guarded_answers(answers(s, d), evidence(s, d))
    return g.select("answer_id", "response", F.array_join("trace", "|").alias("trace"))


def _tool_results(s, d):
    # every turn before an answer counts as one tool result of that answer's conversation
    t = table(s, d, "conversations")
    return t.selectExpr("conv_id AS answer_id", "turn AS seq", "role AS tool", "text AS content",
                        "length(text) AS duration_ms", "CAST(floor(turn / 2) AS INT) + 1 AS iteration")


def q_longest_evidence(s, d):
    return gr.longest_evidence(_tool_results(s, d))


def q_tool_trace_summary(s, d):
    trace = _tool_results(s, d).withColumn("result_count", gr.result_count(
        F.when(F.col("tool") == "user", "list").otherwise("dict"), F.size(tx.sentences(F.col("content"))),
        F.col("tool") == "system", F.col("content").startswith("T")))
    return gr.tool_trace_summary(trace)


def q_extractive_answers(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    return answer.extractive_answers(q, retrieve.hybrid_retrieve(q, c))


def q_answer_questions(s, d):
    q, c = questions(s, d), index_chunks(s, d)
    from docquarry.session import persist_table

    found = persist_table(retrieve.hybrid_retrieve(q, c), "retrieved")
    final = answer.answer_questions(q, found, answer.extractive_answers(q, found), "it@example.org")
    return final.select("query_id", "query", "response", F.size("citations").alias("n_citations"),
                        F.size("retrieved").alias("n_retrieved"), "refused")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# --- SQL -----------------------------------------------------------------------------------

_YEARS = r"\b(19[89][0-9]|20[0-9][0-9])\b"


def _core(x: str) -> str:
    return sql_strip(f"regexp_replace({sql_strip(f'''regexp_replace({x}, {qt(_CITE_RX)}, '', 'g')''')}, {qt('^[-*•0-9]+[.]?' + WS + '*')}, '')")


def _long(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[{WCH}]+'), lambda w: length(w) >= 3)"


def _supported(core: str, hay: str) -> str:
    """``core`` and ``hay`` are columns; ``hay`` is lower case."""
    return (
        f"CASE WHEN {core} = '' THEN false WHEN contains({hay}, lower({core})) THEN true "
        f"WHEN contains({hay}, lower({sql_strip(f'''split_part({core}, ',', 1)''')})) THEN true "
        f"WHEN len(list_filter(regexp_extract_all({_ascii(core)}, {qt(_YEARS)}), lambda y: NOT contains({hay}, y))) > 0 THEN false "
        f"ELSE len(list_filter({_long(core)}, lambda w: contains({hay}, w))) >= 2 AND "
        f"len(list_filter({_long(core)}, lambda w: contains({hay}, w))) >= 0.25 * len({_long(core)}) END"
    )


_SRC = "split_part(lower({x}), '.', 1)"


def _same(a: str, b: str) -> str:
    a, b = _SRC.format(x=a), _SRC.format(x=b)
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def _sent(base: str, column: str) -> str:
    return (
        f"sent AS (SELECT answer_id, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM (SELECT answer_id, {sql_sentences(column)} AS ss FROM {base})), "
        f"cores AS (SELECT *, {_core('s')} AS core, {sql_strip(f'''regexp_replace(s, {qt(_CITE_RX)}, '', 'g')''')} AS bare FROM sent)"
    )


_BEST = (
    "sc AS (SELECT c.*, e.rank, e.source, e.location, e.content, lower(e.content) AS hay, "
    f"len(list_intersect(list_distinct({_long('c.bare')}), list_distinct(regexp_extract_all(lower(e.content), '[{WCH}]+')))) AS shared "
    "FROM cores c JOIN evidence e USING (answer_id)), "
    f"best AS (SELECT * FROM (SELECT *, {_supported('core', 'hay')} AS ok FROM sc WHERE shared > 0) WHERE ok "
    "QUALIFY row_number() OVER (PARTITION BY answer_id, pos ORDER BY shared DESC, rank, source, location, content) = 1)"
)
_PLACE = fixed.PLACEHOLDER_NAMES.replace("{s}", WS + "+")
_GROUND = with_answers(
    ", " + "rewritten AS (" + _ENDNOTES_SQL[_ENDNOTES_SQL.index("SELECT answer_id, CASE WHEN len(num)"):] + "), "
    + _sent("rewritten", "answer") + ", " + _BEST + ", "
    "cit AS (SELECT answer_id, pos, unnest(regexp_extract_all(s, " + qt(_CITE_PARTS) + ", 1)) AS cs FROM sent), "
    "citok AS (SELECT t.answer_id, t.pos, bool_and(ok) AS ok FROM (SELECT i.answer_id, i.pos, i.cs, any_value(c.core) AS core, "
    "string_agg(e.content, chr(10) || chr(10) ORDER BY e.rank, e.source, e.location, e.content) AS txt FROM cit i JOIN cores c USING (answer_id, pos) "
    f"LEFT JOIN evidence e ON e.answer_id = i.answer_id AND {_same('e.source', sql_strip('i.cs'))} GROUP BY ALL) t, LATERAL (SELECT txt IS NOT NULL AND "
    f"({_supported('core', 'lower(txt)')}) AS ok) GROUP BY ALL), "
    "lab AS (SELECT c.*, b.source, b.location, citok.ok AS cok, CASE "
    f"WHEN regexp_matches(bare, {qt('(?i)' + fixed.META_PATTERN)}) THEN 'meta' "
    f"WHEN regexp_matches(bare, {qt('(?i)[[](?:' + _PLACE + ')[]]|[*][*](?:' + _PLACE + ')[*][*]')}) THEN 'placeholder' "
    f"WHEN regexp_matches(replace(replace(bare, '’', ''''), '`', ''''), {qt('(?i)' + fixed.FALLBACK_PATTERN)}) THEN 'fallback' "
    f"WHEN len(regexp_extract_all(bare, {qt(NWS + '+')})) <= 4 THEN 'short' "
    f"WHEN regexp_matches(bare, {qt('(?i)' + fixed.TRANSITION_PATTERN.replace('{s0}', WS + '+'))}) THEN 'transition' "
    "WHEN citok.ok THEN 'cited' WHEN NOT citok.ok THEN 'bad_citation' WHEN b.source IS NOT NULL THEN 'auto_cited' ELSE 'unsupported' END AS label "
    "FROM cores c LEFT JOIN citok USING (answer_id, pos) LEFT JOIN (SELECT answer_id, pos, source, location FROM best) b USING (answer_id, pos)), "
    "fin AS (SELECT answer_id, pos, label, CASE WHEN label IN ('placeholder', 'bad_citation', 'unsupported') THEN NULL "
    "WHEN label = 'auto_cited' THEN rtrim(bare, '.') || ' [Citation: ' || source || ', ' || location || '].' ELSE s END AS text FROM lab)",
    True,
)
# the endnote steps n, m, r come from the stand-alone query
_GROUND = _GROUND.replace(", rewritten AS (", _ENDNOTES_SQL[_ENDNOTES_SQL.index(",\nn AS ("):_ENDNOTES_SQL.index("SELECT answer_id, CASE WHEN len(num)")]
                          + ", rewritten AS (", 1)

_MEDIA_SQL = f"media AS (SELECT answer_id, rank, {_MEDIA} AS source, location, content FROM evidence)"
_SIDE_SQL = (
    _MEDIA_SQL + ", base AS (SELECT *, regexp_replace(regexp_extract(source, '[^/]*$'), '\\.[^.]*$', '') AS b FROM media), "
    "side AS (SELECT * FROM base x WHERE NOT (contains(x.source, 'multimedia/') AND regexp_matches(x.source, '\\.(png|jpg|jpeg|webp)$') AND EXISTS ("
    "SELECT 1 FROM base y WHERE y.answer_id = x.answer_id AND y.b = x.b AND contains(y.source, 'multimedia/') AND ends_with(y.source, '.md'))))"
)


def _ctx(source: str, name: str = "ctx") -> str:
    return (f"{name} AS (SELECT answer_id, string_agg(source || ' | ' || location || ' | ' || content, chr(10) ORDER BY rank, source, location, content) AS context "
            f"FROM {source} WHERE content <> '' GROUP BY answer_id)")


def _comparable(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {qt(WS + '+')}, ' ', 'g'), '.,;:!?')"


def _claim_ok(claim: str, ctx: str) -> str:
    n = _comparable(claim)
    m = sql_strip(f"regexp_replace({n}, {qt('^(?:the|this|that|these|those|a|an)' + WS + '+')}, '')")
    bare = sql_strip(f"regexp_replace({m}, {qt('[^' + WCH + WS[1:])}, '', 'g')")
    parts = f"regexp_extract_all({m}, {qt(NWS + '+')})"
    num = f"regexp_extract({n}, '[0-9]+(?:[.,][0-9]+)?')"
    return (
        f"({n} = '' OR {m} = '' OR contains({ctx}, {m}) OR contains({ctx}, {n}) OR ({bare} <> '' AND contains({ctx}, {bare})) OR "
        f"(len({parts}) >= 2 AND (contains({ctx}, array_to_string({parts}[-2:], ' ')) OR (length({parts}[-1]) > 3 AND contains({ctx}, {parts}[-1])))) OR "
        f"({num} <> '' AND contains({ctx}, {num})))"
    )


_FOOT = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, " + qt(f"(?i)\\[Citation:{WS}*[^\\]]+\\]") + ", ' ', 'g'), "
    + qt(f"(?i)\\[(?:Source|Location):{WS}*[^\\]]+\\]") + ", ' ', 'g'), '\\[\\p{Nd}+\\]', ' ', 'g'), "
    + qt(f"(?i)\\[(?:Source|Citation){WS}*[^\\]]*\\]") + ", ' ', 'g')"
)


def _check(base: str) -> str:
    """Unsupported claims of ``base`` (answer_id, answer, context)."""
    return (
        f"foot AS (SELECT answer_id, answer, context, {sql_strip(_FOOT)} AS foot, {_comparable('context')} AS cmp FROM {base}), "
        f"chk AS (SELECT *, CASE WHEN {sql_refused('foot')} THEN []::VARCHAR[] WHEN {sql_strip('''coalesce(context, '')''')} = '' THEN ['<no context>'] "
        f"ELSE list_filter({sql_claims('foot')}, lambda c: NOT {_claim_ok('c', 'cmp')}) END AS bad FROM foot)"
    )


ORACLES = {
    "citation_match": with_answers(
        f", c AS (SELECT answer_id, unnest(range(len(src))) AS pos, unnest(src) AS source, unnest(loc) AS location FROM (SELECT answer_id, "
        f"list_transform(regexp_extract_all(answer, {qt(_CITE_PARTS)}, 1), lambda x: {sql_strip('x')}) AS src, "
        f"list_transform(regexp_extract_all(answer, {qt(_CITE_PARTS)}, 2), lambda x: {sql_strip(f'''rtrim({sql_strip('x')}, ')')''')}) AS loc FROM answers)) "
        f"SELECT c.answer_id, c.pos, c.source, c.location, count(e.answer_id) AS n_match FROM c LEFT JOIN evidence e ON e.answer_id = c.answer_id AND "
        f"{_same('e.source', 'c.source')} GROUP BY ALL", True),
    "sentence_support": with_answers(
        f", {_sent('answers', 'answer')} SELECT c.answer_id, c.pos, count(*) FILTER ({_supported('core', 'lower(e.content)')}) AS n_supporting "
        "FROM cores c JOIN evidence e USING (answer_id) GROUP BY ALL", True),
    "auto_cite": with_answers(
        f", {_sent('answers', 'answer')}, {_BEST} SELECT c.answer_id, c.pos, b.source, b.location FROM cores c LEFT JOIN best b USING (answer_id, pos)", True),
    "ground_labels": _GROUND + " SELECT answer_id, pos, label, text FROM fin",
    "ground_answers": _GROUND + (
        f" SELECT a.answer_id, CASE WHEN coalesce({sql_strip('g.t')}, '') = '' THEN {qt(fixed.NOT_FOUND_ANSWER)} ELSE {sql_strip('g.t')} END AS grounded "
        "FROM answers a LEFT JOIN (SELECT answer_id, string_agg(text, ' ' ORDER BY pos) AS t FROM fin GROUP BY answer_id) g USING (answer_id)"),
    "sidecar_evidence": with_answers(f", {_SIDE_SQL} SELECT answer_id, rank, source FROM side", True),
    "evidence_context": with_answers(
        f", {_SIDE_SQL}, {_ctx('side')} SELECT answer_id, length(context) AS n, md5(context) AS context FROM ctx", True),
    "claim_support": with_answers(
        f", {_ctx('evidence')}, a AS (SELECT answer_id, {_comparable('''coalesce(context, '')''')} AS ctx, {sql_claims('answer')} AS cs FROM answers LEFT JOIN ctx USING (answer_id)), "
        "c AS (SELECT answer_id, ctx, unnest(range(len(cs))) AS pos, unnest(cs) AS claim FROM a) "
        f"SELECT answer_id, pos, claim, {_claim_ok('claim', 'ctx')} AS supported FROM c", True),
    "grounding_check": with_answers(
        f", b AS (SELECT answer_id, answer, CASE WHEN conv_id % 10 = 3 THEN ' ' ELSE question END AS context FROM answers), {_check('b')} "
        "SELECT answer_id, len(bad) = 0 AS ok, array_to_string(bad, '|') AS unsupported FROM chk"),
    "guarded_answers": with_answers(
        f", {_ctx('evidence')}, b AS (SELECT answer_id, answer, context FROM answers LEFT JOIN ctx USING (answer_id)), {_check('b')} "
        f"SELECT answer_id, CASE WHEN {sql_refused('answer')} OR len(bad) = 0 THEN answer ELSE {qt(fixed.STRICT_REFUSAL)} END AS response, "
        f"CASE WHEN NOT {sql_refused('answer')} AND len(bad) > 0 THEN array_to_string(bad[:10], '|') END AS trace FROM chk", True),
    "longest_evidence": "SELECT conv_id AS answer_id, role AS tool, text AS content FROM conversations "
                        "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1",
    "tool_trace_summary": (
        "SELECT conv_id AS answer_id, count(*) AS calls, sum(length(text)) AS duration_ms, max(turn // 2 + 1) AS iterations, "
        f"sum(CASE WHEN role = 'user' THEN len({sql_sentences('text')}) WHEN role = 'system' AND NOT starts_with(text, 'T') THEN 0 ELSE 1 END) AS results "
        "FROM conversations GROUP BY conv_id"),
    "extractive_answers": with_index(
        f", {HYBRID_SQL}, t AS (SELECT query_id, list_distinct(keywords) AS terms FROM kw), "
        f"hs AS (SELECT h.query_id, h.rank, h.source, h.location, t.terms, {sql_sentences('h.content')} AS ss FROM hybrid h JOIN t USING (query_id)), "
        "x AS (SELECT * EXCLUDE (ss), unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM hs), "
        f"y AS (SELECT *, len(list_intersect(terms, list_distinct(regexp_extract_all(lower(s), '[{WCH}]+')))) AS shared FROM x), "
        "z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank, pos) = 1) "
        "SELECT query_id, CASE WHEN shared > 0 THEN rtrim(s, '.') || ' [Citation: ' || source || ', ' || location || '].' "
        "ELSE 'I cannot find this in the indexed documents.' END AS answer FROM z"),
}
