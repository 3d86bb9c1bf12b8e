"""Registered queries: chunking, scrubbing, extraction, answer classes, media text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions import text as tx
from docquarry.operators import chunking
from docquarry.registry.views import SUFFIX, answers, table, with_answers
from docquarry.session import shared_dir, spread
from docquarry.sources.files import read_texts

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
WCH = r"\p{L}\p{N}_"


def qt(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# --- text views shared by several queries: whole documents with a few marks woven in ------

PII_TEXT = (
    "concat(text, ' mail: user', CAST(doc_id AS VARCHAR(20)), '@example.org key = \"abcdef0123456789', "
    "CAST(doc_id AS VARCHAR(20)), '\" AKIA', upper(substr(md5(text), 1, 16)), ' end')"
)
QUERY_LEAD = (
    "CASE CAST(item_id % 8 AS INT) WHEN 0 THEN 'Explain ' WHEN 1 THEN 'How do I find ' WHEN 2 THEN 'Who wrote ' "
    "WHEN 3 THEN 'Differences of ' WHEN 4 THEN 'Unexplained ' WHEN 5 THEN 'Why is ' WHEN 6 THEN 'In detail: ' ELSE '' END"
)


def _docs(s, d):
    return spread(table(s, d, "documents"), "doc_id")


def q_chunk_text(s, d):
    return chunking.chunk_text(_docs(s, d).select("doc_id", "text"))


def q_chunk_code(s, d):
    defs = F.regexp_replace("text", r"\n(The|Than|Le|Er|In) ", "\ndef ")
    code = _docs(s, d).select("doc_id", F.regexp_replace(defs, " (the|le|die) ", "\n").alias("text"))
    return chunking.chunk_code(code)


def q_scrub_pii(s, d):
    return _docs(s, d).selectExpr("doc_id", f"{PII_TEXT} AS text").select("doc_id", tx.scrub(F.col("text")).alias("content"))


def q_pii_report(s, d):
    kinds = tx.redactions(F.col("text"))
    counted = _docs(s, d).selectExpr("doc_id", "source", f"{PII_TEXT} AS text").select(
        "source", *[c.alias(k) for k, c in kinds.items()])
    return counted.groupBy("source").agg(*[F.sum(k).alias(k) for k in kinds], F.count("*").alias("documents"))


def q_front_matter_acl(s, d):
    docs = _docs(s, d).selectExpr(
        "doc_id",
        "CASE CAST(doc_id % 4 AS INT) "
        "WHEN 0 THEN concat('---\\ntitle: t\\nkgf_permissions:\\n  visibility: Team\\n  groups: [', lang, ', \"', source, '\"]\\n  users: []\\n---\\n', text) "
        "WHEN 1 THEN concat('---\\nkgf_permissions:\\n  groups:\\n    - ', lang, '\\n    - ', source, '\\n  users: [u', doc_id, '@x.org]\\nowner: o\\n---\\n', text) "
        "WHEN 2 THEN concat('---\\ntitle: none\\n---\\n', text) ELSE text END AS text")
    fm = docs.select("doc_id", chunking.front_matter(F.col("text")).alias("f"))
    return fm.select(
        "doc_id", F.col("f.permissions.visibility").alias("visibility"),
        F.array_join("f.permissions.groups", ",").alias("groups"), F.array_join("f.permissions.users", ",").alias("users"),
        F.md5("f.body").alias("body"))


def q_answer_sentences(s, d):
    return tx.unroll(answers(s, d), tx.sentences(F.col("answer")), "pos", "sentence", ["answer_id"])


def q_extract_citations(s, d):
    a = answers(s, d).select("answer_id", tx.citations(F.col("answer")).alias("c"), tx.cited_names(F.col("answer")).alias("n"))
    return tx.unroll(a, F.col("c"), "pos", "c", ["answer_id", "n"]).select(
        "answer_id", "pos", "c.source", "c.location", F.array_join("n", ";").alias("names"))


def q_strip_citations(s, d):
    return answers(s, d).select("answer_id", tx.strip_citations(F.col("answer")).alias("plain"),
                                tx.strip_footers(F.col("answer")).alias("bare"))


def q_rewrite_endnotes(s, d):
    return answers(s, d).select("answer_id", tx.rewrite_endnotes(F.col("answer")).alias("answer"))


def q_extract_claims(s, d):
    a = tx.unroll(answers(s, d), tx.claims(F.col("answer")), "pos", "claim", ["answer_id"])
    return a.withColumn("kind", tx.claim_kind(F.col("claim")))


def q_refusal_flags(s, d):
    a = answers(s, d)
    n = F.size(tx.citations(F.col("answer")))
    return a.select("answer_id", tx.refused(F.col("answer")).alias("tool_loop"),
                    tx.eval_refused(F.col("answer"), n).alias("evaluation"), tx.no_answer(F.col("answer")).alias("route"))


def q_question_type(s, d):
    q = table(s, d, "benchmark").selectExpr("item_id", f"concat({QUERY_LEAD}, text) AS query")
    kind = tx.question_type(F.col("query"))
    return q.select("item_id", kind.alias("kind"), F.when(kind == "factual", fixed.TEMPERATURE["factual"]).otherwise(
        fixed.TEMPERATURE["exploratory"]).alias("temperature"))


def q_clean_answers(s, d):
    a = answers(s, d).selectExpr(
        "answer_id",
        "concat('<|im_start|>', answer, '<|tool_call|> ```json [1, 2] ``` {\"results\": [\"x\"] } ', "
        "'[{\"name\": \"read_chunk\", \"arguments\": {\"a\": 1}}]', '<|user|>echo', CHR(10), CHR(10), 'tail <|im_end|>') AS answer")
    return a.select("answer_id", tx.clean_answer(F.col("answer")).alias("answer"))


_SEGMENT = {"source": "concat('talks/talk-', CAST(conv_id AS VARCHAR(20)), '.mp4')", "start": "turn * 731.4",
            "end": "turn * 731.4 + length(text) / 10.0", "text": "text"}


def _segments(s, d):
    """Conversation turns as speech segments."""
    return table(s, d, "conversations").selectExpr(
        *[f"CAST({e} AS {'DOUBLE' if c in ('start', 'end') else 'STRING'}) AS `{c}`" for c, e in _SEGMENT.items()])


def q_transcript_chunks(s, d):
    return chunking.transcript_chunks(_segments(s, d))


def q_clean_ocr_lines(s, d):
    return _docs(s, d).select("doc_id", tx.clean_ocr(F.regexp_replace("text", r"\. ", "\n")).alias("content"))


def q_relevance_gate(s, d):
    return _docs(s, d).select("doc_id", (tx.telling_description(F.col("text")) != "").alias("kept"))


_IMAGES = {
    "source": "concat('multimedia/', CAST(page_id AS VARCHAR(20)), '.png')",
    "page": "CAST(page_id % 9 AS INT)", "image": "CAST(page_id % 3 AS INT)",
    "chars": "length(url) * 20", "width": "CAST(100 + page_id % 70 AS INT)", "height": "CAST(60 + page_id % 50 AS INT)",
    "confidence": "CAST(40 + page_id % 50 AS DOUBLE)",
    "ocr": "CASE WHEN page_id % 4 = 0 THEN '' ELSE url END",
    "description": "CASE WHEN page_id % 5 = 0 THEN 'plain' ELSE html END",
}


def _images(s, d):
    return table(s, d, "pages").selectExpr("page_id", *[f"{e} AS {c}" for c, e in _IMAGES.items()])


def q_density_route(s, d):
    i = _images(s, d)
    density = tx.text_density(F.col("chars"), F.col("width") * F.col("height"))
    return i.select("page_id", F.round(density, 6).alias("density"),
                    tx.density_route(density, F.col("confidence")).alias("route"))


def q_image_chunks(s, d):
    spaced = _images(s, d).withColumn("ocr", F.regexp_replace("ocr", "/", " "))
    return chunking.image_chunks(spaced)


def q_scanned_pages(s, d):
    p = table(s, d, "pages").select(
        "page_id", F.regexp_replace("html", "(?s)<[^>]*>", "").alias("text"), (F.length("html") * 64).alias("bytes"))
    return p.select("page_id", tx.scanned_page(F.col("text"), F.col("bytes")).alias("scanned"))


def q_content_hash(s, d):
    return _docs(s, d).select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


def q_truncate_text(s, d):
    return _docs(s, d).select("doc_id", tx.truncate(F.col("text"), 2000).alias("tool_result"),
                              tx.truncate(F.col("text"), 1200).alias("slice"), F.substring("text", 1, 512).alias("pair"))


def q_extract_ids(s, d):
    return tx.unroll(answers(s, d), tx.specifics(F.col("answer")), "pos", "item", ["answer_id"])


def q_thread_chunks(s, d):
    m = table(s, d, "conversations").selectExpr(
        "conv_id AS thread_id", "turn AS seq", "role AS author", "concat('#room-', conv_id % 7) AS channel",
        "concat('2024-01-0', 1 + conv_id % 9) AS sent", "text AS body")
    return chunking.thread_chunks(m)


def q_mail_chunks(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", chunking.mail_chunk(
        F.concat("role", F.lit("@example.org")), F.concat(F.lit("Conversation "), "conv_id"), F.col("text")).alias("content"))


def q_embedding_prompts(s, d):
    return table(s, d, "benchmark").select("item_id", tx.with_prefix(F.col("text"), "query").alias("prompt"))


def _keys(s, d):
    return _docs(s, d).selectExpr("doc_id", f"{KEY} AS key", "text", "n_chars")


KEY = (
    "CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN concat('readme-', CAST(doc_id AS VARCHAR(20)), '.MD') "
    "WHEN 1 THEN concat('multimedia/clip-', CAST(doc_id AS VARCHAR(20)), '.mp4') "
    "WHEN 2 THEN concat('multimedia/', source, '/shot-', CAST(doc_id AS VARCHAR(20)), '.v2.png') "
    "WHEN 3 THEN concat('calls/', source, '/call-', CAST(doc_id AS VARCHAR(20)), '.mp3') "
    "WHEN 4 THEN concat('internal/__cache', CAST(doc_id AS VARCHAR(20)), '.py') "
    "WHEN 5 THEN concat(source, '/seed.py') WHEN 6 THEN concat('internal/.hidden', CAST(doc_id AS VARCHAR(20))) "
    f"ELSE concat('compliance/', source, '/doc-', CAST(doc_id AS VARCHAR(20)), {SUFFIX}) END"
)


def q_route_files(s, d):
    k = F.col("key")
    return _keys(s, d).select(
        "key", tx.extension_of(k).alias("ext"), tx.is_allowed(k).alias("allowed"), tx.handler_of(k).alias("handler"),
        tx.category_of(k).alias("category"), tx.source_uri(k).alias("source"), tx.source_uri(k, "kb").alias("object"),
        tx.stem_of(k).alias("stem"))


_FOLDER_NAME = "concat(CASE WHEN item_id % 5 = 1 THEN '__' ELSE 'note-' END, CAST(item_id AS VARCHAR(20)), CASE WHEN item_id % 3 = 0 THEN '.md' WHEN item_id % 3 = 1 THEN '.exe' ELSE '.py' END)"


def q_folder_scan(s, d):
    from docquarry.sources.files import is_user_file

    k = _keys(s, d)
    return k.filter(is_user_file(F.col("key"))).groupBy(tx.category_of(F.col("key")).alias("category")).agg(
        F.countDistinct("key").alias("files"))


def q_folder_read(s, d):
    """Benchmark texts as files of a folder, scanned and read back; names decide which are taken."""
    folder = shared_dir(s, "folder")
    named = table(s, d, "benchmark").selectExpr(f"{_FOLDER_NAME} AS name", "text")
    # a folder for each name, as writers make them; line breaks of a text are lines of its file
    named.select("name", F.explode(F.split("text", "\n")).alias("value")).repartition("name").write.partitionBy("name").text(folder)
    files = read_texts(s, folder, name_of=F.regexp_extract("path", "name=([^/]*)/", 1))
    return files.select("key", F.md5(F.rtrim("text", F.lit("\n"))).alias("text"), F.length("file_hash").alias("n"))


def q_upload_intake(s, d):
    from docquarry.sources.files import intake

    up = _keys(s, d).withColumn("text", F.when(F.col("n_chars") > 500, F.col("text")).otherwise(F.lit(" \n")))
    ok, rejected = intake(up)
    return ok.select("doc_id", F.lit("accepted").alias("result")).unionByName(
        rejected.select("doc_id", F.col("reason").alias("result")))


def q_drop_blank(s, d):
    t = table(s, d, "conversations").withColumn(
        "content", F.when(F.col("role") == "system", F.lit(" \n\t")).otherwise(F.col("text")))
    return t.filter(~tx.is_blank(F.col("content"))).groupBy("role").agg(F.count("*").alias("n"))


def q_valid_questions(s, d):
    from docquarry.plans.retrieve import valid_questions

    # whole texts, and a question of one to eight characters of each role's name
    t = table(s, d, "conversations")
    q = t.selectExpr("conv_id", "turn", "text AS query").unionByName(
        t.selectExpr("conv_id", "turn", "concat('  ', substr(role, 1, CAST(1 + turn % 8 AS INT)), ' ') AS query"))
    return valid_questions(q).select("conv_id", "turn", F.length("query").alias("n"))


def q_top_k_clamps(s, d):
    from docquarry.operators.fusion import clamp

    t = table(s, d, "conversations").select("conv_id", "turn", (F.length("text") - 60).alias("k"))
    return t.select("conv_id", "turn", clamp(F.col("k"), 1, 8).alias("query"), clamp(F.col("k"), 1, 20).alias("search"),
                    clamp(F.col("k"), 1, 200).alias("activity"), clamp(F.col("k"), 1, 5).alias("iterations"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# --- SQL ------------------------------------------------------------------------------------

_CHUNK_SQL = """
WITH RECURSIVE src AS (SELECT doc_id, text, length(text) AS n FROM documents),
ends AS (
  SELECT doc_id, 0::BIGINT AS s, CAST(NULL AS BIGINT) AS e, 0 AS step FROM src
  UNION ALL
  SELECT doc_id, CASE WHEN nl > 0 AND nx < n THEN nx + nl ELSE nx END, e, step + 1 FROM (
    SELECT *, position(chr(10) IN substr(text, nx + 1, 200)) AS nl FROM (
      SELECT *, CASE WHEN e - 200 <= s THEN s + 500 ELSE e - 200 END AS nx FROM (
        SELECT doc_id, text, n, s, step, CASE WHEN e0 < n AND back > 0 THEN e0 - back + 1 ELSE e0 END AS e FROM (
          SELECT *, position(chr(10) IN reverse(substr(text, s + 801, e0 - s - 800))) AS back FROM (
            SELECT r.doc_id, r.s, r.step, src.text, src.n, least(r.s + 1000, src.n) AS e0
            FROM ends r JOIN src USING (doc_id) WHERE r.s < src.n))))))
"""
_CHUNK_SQL += """
, cut AS (SELECT a.doc_id, a.s, b.e, a.step FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND b.step = a.step + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS section, content FROM (
  SELECT doc_id, step, substr(text, s + 1, e - s) AS content FROM cut JOIN src USING (doc_id))
WHERE trim(content, %s) <> ''
""" % TRIM

_CODE_SQL = r"""
WITH RECURSIVE src AS (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN substr(t, 1, length(t) - 1) ELSE t END, chr(10)) AS ls
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\n(The|Than|Le|Er|In) ', chr(10) || 'def ', 'g'), ' (the|le|die) ', chr(10), 'g') AS t FROM documents)),
walk AS (
  SELECT doc_id, 0 AS i, 0 AS held, 0 AS block FROM src
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN h >= 80 THEN 0 ELSE h END, block + CASE WHEN fresh THEN 1 ELSE 0 END FROM (
    SELECT *, CASE WHEN fresh THEN 1 ELSE held + 1 END AS h FROM (
      SELECT w.doc_id, w.i, w.held, w.block, w.held = 0 OR (w.held >= 30 AND regexp_matches(src.ls[w.i + 1],
        '^\s*(class\s+|def\s+|async\s+def\s+|function\s+|func\s+|struct\s+|interface\s+)')) AS fresh
      FROM walk w JOIN src USING (doc_id) WHERE w.i < len(src.ls)))),
blocks AS (SELECT doc_id, walk.block, string_agg(src.ls[walk.i], chr(10) ORDER BY walk.i) AS content FROM walk JOIN src USING (doc_id)
  WHERE walk.i > 0 GROUP BY doc_id, walk.block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY blocks.block) AS block, content FROM blocks WHERE trim(content, %s) <> ''
""" % TRIM

_S = WS
_SECRET_RX = f"(?i)((?:key|secret|token|password|auth){_S}*)[:=]{_S}*['\"][a-zA-Z0-9_\\-]{{16,}}['\"]"
_SCRUB = (
    "regexp_replace(regexp_replace(regexp_replace($TEXT, " + qt(fixed.CLOUD_KEY_PATTERN) + ", '[REDACTED_AWS_KEY]', 'g'), "
    + qt(_SECRET_RX) + ", '\\1: \"[REDACTED_SECRET]\"', 'g'), " + qt(fixed.EMAIL_PATTERN) + ", '[REDACTED_EMAIL]', 'g')"
)


def sql_scrub(x: str) -> str:
    return _SCRUB.replace("$TEXT", x)


_CITE_RX = f"(?i)\\[Cit(?:ation|e)?:{_S}*[^\\]]+\\]"
_CITE_PARTS = (f"(?i)\\[Cit(?:ation|e)?:{_S}*([^,)|{_S[1:]}+){_S}*(?:,{_S}*|\\({_S}*|\\|{_S}*(?:Location:{_S}*)?)([^)\\]]+?){_S}*\\)?\\]")


def sql_strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def sql_sentences(x: str) -> str:
    """Sentences of an expression, as a list."""
    pieces = (f"list_filter(string_split(regexp_replace(line, {qt('([.!?])' + _S + '+')}, '\\1' || chr(1), 'g'), chr(1)), "
              f"lambda p: {sql_strip('p')} <> '')")
    no_break = f"^\\p{{Lu}}\\.*$|^\\p{{Nd}}+\\.*$|(?i:(?:^|[^{WCH}])(?:{'|'.join(fixed.ABBREVIATIONS)})\\.$)"
    joined = (f"array_to_string(list_transform({pieces}, lambda p: p || CASE WHEN regexp_matches(regexp_extract({sql_strip('p')}, "
              f"{qt(NWS + '+$')}), {qt(no_break)}) THEN ' ' ELSE chr(1) END), '')")
    return (f"flatten(list_transform(string_split({x}, chr(10)), lambda line: list_filter(list_transform(string_split({joined}, chr(1)), "
            f"lambda s: {sql_strip('s')}), lambda s: s <> '')))")


# claims match ASCII only, so other letters can become one word sign before RE2's ASCII edges look at them
def _ascii(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '_', 'g')"


_CLAIM_RX = (
    f"(\\b(?:INR|USD|EUR|GBP|Rs|₹|\\$|€|£)\\b|\\b[0-9]{{1,3}}(?:[.,][0-9]+)?(?:%|x|×)?\\b|\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b"
    f"|\\b(?:{'|'.join(fixed.MONTHS)})[a-z]*\\b{_S}+[0-9]{{1,2}}(?:,{_S}*[0-9]{{4}})?"
    f"|\\b[A-Z][a-z]{{2,}}(?:{_S}+[A-Z][a-z]{{2,}})?\\b)"
)
_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in fixed.CLAIM_STOPWORDS) + "]"


def sql_claims(x: str) -> str:
    return f"list_filter(regexp_extract_all({_ascii(x)}, {qt(_CLAIM_RX)}), lambda c: NOT list_contains({_STOP_LIST}, lower(c)))"


def sql_refused(x: str) -> str:
    v = f"lower({sql_strip(x)})"
    starts = " OR ".join(f"starts_with({v}, {qt(p)})" for p in fixed.REFUSAL_STARTS)
    return f"({v} = '' OR {starts} OR regexp_matches(substr({v}, 1, 240), {qt('|'.join(f'(?:{p})' for p in fixed.REFUSAL_HEAD_PATTERNS))}))"


_EVAL_REFUSED = (
    f"(trim(answer, {TRIM}) = '' OR regexp_matches(answer, {qt('(?i)' + fixed.EVAL_REFUSAL_PATTERN)}) OR "
    f"(len(regexp_extract_all(answer, {qt(_CITE_PARTS)})) = 0 AND regexp_matches(answer, {qt('(?i)' + fixed.EVAL_HEDGE_PATTERN)})))"
)
_EXPLORE = "|".join(
    f"(?:^|[^{WCH}]){t}" + (f"(?:$|[^{WCH}])" if closed else "") for t, closed in fixed.EXPLORATORY_WORDS)
SPECIFIC_RX = (
    rf"(CVE-[0-9]{{4}}-[0-9]+|AML\.T[0-9]+|T[0-9]{{4}}(?:\.[0-9]{{3}})?|\b(?:19|20)[0-9]{{2}}\b|\${_S}?[0-9][0-9,]*\.?[0-9]*{_S}?[KMB]?)"
)

_ENDNOTE_RX = f"(?im)^\\[([0-9]+)\\]{_S}*source:{_S}*([^,\\n]+),{_S}*location:{_S}*(.+)$"
_ENDNOTES_SQL = with_answers(f""",
n AS (SELECT answer_id, answer, regexp_extract_all(answer, {qt(_ENDNOTE_RX)}, 1) AS num, regexp_extract_all(answer, {qt(_ENDNOTE_RX)}, 2) AS src,
  regexp_extract_all(answer, {qt(_ENDNOTE_RX)}, 3) AS loc, {sql_strip(f"regexp_replace(answer, {qt(_ENDNOTE_RX)}, '', 'g')")} AS body FROM answers),
m AS (SELECT *, list_transform(range(1, len(num) + 1), lambda i: '[Citation: ' || {sql_strip('src[i]')} || ', ' || {sql_strip('loc[i]')} || ']') AS marks FROM n),
r AS (SELECT *, CASE WHEN len(num) = 0 THEN answer ELSE array_to_string(list_transform(string_split_regex(body, '\\[[0-9]+\\]'), lambda p, i: p || CASE
  WHEN i > len(regexp_extract_all(body, '\\[[0-9]+\\]')) THEN ''
  WHEN list_contains(num, regexp_extract_all(body, '\\[([0-9]+)\\]', 1)[i]) THEN ' ' ||
    marks[len(num) + 1 - list_position(list_reverse(num), regexp_extract_all(body, '\\[([0-9]+)\\]', 1)[i])]
  ELSE regexp_extract_all(body, '\\[[0-9]+\\]')[i] END), '') END AS inl FROM m)
SELECT answer_id, CASE WHEN len(num) > 0 AND len(list_distinct(num)) = 1 AND NOT contains(inl, '[Citation:')
  THEN replace(regexp_replace(inl, {qt('([.!?])(' + _S + '+|$)')}, chr(1) || '\\1\\2', 'g'), chr(1), ' ' || marks[-1]) ELSE inl END AS answer FROM r""")

_EXTS = "[" + ", ".join(f"'{e}'" for e in fixed.ALLOWED_EXTS) + "]"


def _exts(items: list[str]) -> str:
    return "(" + ", ".join(f"'{e}'" for e in items) + ")"


_KEYS_SQL = f"keys AS (SELECT doc_id, {KEY} AS key, text, n_chars FROM documents), ex AS (SELECT *, lower(regexp_extract(regexp_extract(key, '[^/]*$'), '^\\.*[^.].*(\\.[^.]+)$', 1)) AS ext FROM keys)"
_USER_FILE = f"list_contains({_EXTS}, ext) AND NOT starts_with(regexp_extract(key, '[^/]*$'), '__') AND regexp_extract(key, '[^/]*$') <> 'seed.py'"

ORACLES = {
    "chunk_text": _CHUNK_SQL,
    "chunk_code": _CODE_SQL,
    "scrub_pii": f"SELECT doc_id, {sql_scrub(PII_TEXT)} AS content FROM documents",
    "pii_report": f"SELECT source, sum(len(regexp_extract_all(t, {qt(fixed.CLOUD_KEY_PATTERN)}))) AS cloud_keys, "
                  f"sum(len(regexp_extract_all(t, {qt(_SECRET_RX)}))) AS secrets, "
                  f"sum((length({sql_scrub('t')}) - length(replace({sql_scrub('t')}, '[REDACTED_EMAIL]', ''))) // 16) AS emails, "
                  f"count(*) AS documents FROM (SELECT source, {PII_TEXT} AS t FROM documents) GROUP BY source",
    "front_matter_acl": "SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'team' WHEN 1 THEN 'public' END AS visibility, "
                        "CASE WHEN doc_id % 4 < 2 THEN lang || ',' || source END AS groups, "
                        "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'u' || doc_id || '@x.org' END AS users, md5(text) AS body FROM documents",
    "answer_sentences": with_answers(
        f"SELECT answer_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT answer_id, {sql_sentences('answer')} AS ss FROM answers)"),
    "extract_citations": with_answers(
        f"SELECT answer_id, pos, {sql_strip('src[pos + 1]')} AS source, {sql_strip(f'''rtrim({sql_strip('loc[pos + 1]')}, ')')''')} AS location, names FROM ("
        f"SELECT *, unnest(range(len(src))) AS pos FROM (SELECT answer_id, regexp_extract_all(answer, {qt(_CITE_PARTS)}, 1) AS src, "
        f"regexp_extract_all(answer, {qt(_CITE_PARTS)}, 2) AS loc, array_to_string(list_transform(regexp_extract_all(answer, "
        f"{qt(f'(?i)[[]Citation:{_S}*([^]|,]+)')}, 1), lambda x: {sql_strip('x')}), ';') AS names FROM answers))"),
    "strip_citations": with_answers(
        f"SELECT answer_id, {sql_strip(f'''regexp_replace(answer, {qt(_CITE_RX)}, '', 'g')''')} AS plain, " + sql_strip(
            "regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, " + qt(f"(?i)\\[Citation:{_S}*[^\\]]+\\]") + ", ' ', 'g'), "
            + qt(f"(?i)\\[(?:Source|Location):{_S}*[^\\]]+\\]") + ", ' ', 'g'), '\\[\\p{Nd}+\\]', ' ', 'g'), "
            + qt(f"(?i)\\[(?:Source|Citation){_S}*[^\\]]*\\]") + ", ' ', 'g')") + " AS bare FROM answers"),
    "rewrite_endnotes": _ENDNOTES_SQL,
    "extract_claims": with_answers(
        "SELECT answer_id, pos, claim, CASE WHEN regexp_matches(claim, '^(INR|USD|EUR|GBP|Rs|₹|\\$|€|£)$') THEN 'currency' "
        "WHEN regexp_matches(claim, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(claim, '^[0-9]') THEN 'number' "
        "WHEN regexp_matches(claim, '[0-9]') THEN 'month' ELSE 'name' END AS kind FROM ("
        f"SELECT answer_id, unnest(range(len(cs))) AS pos, unnest(cs) AS claim FROM (SELECT answer_id, {sql_claims('answer')} AS cs FROM answers))"),
    "refusal_flags": with_answers(
        f"SELECT answer_id, {sql_refused('answer')} AS tool_loop, {_EVAL_REFUSED} AS evaluation, "
        f"({sql_strip('answer')} = '' OR contains(lower(answer), 'i cannot find') OR contains(lower(answer), 'i cannot answer') OR "
        "(contains(lower(answer), 'i don') AND contains(lower(answer), 'have') AND (contains(lower(answer), 'indexed') OR "
        "contains(lower(answer), 'document')))) AS route FROM answers"),
    "question_type": f"SELECT item_id, kind, CASE kind WHEN 'factual' THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS temperature FROM (SELECT item_id, "
                     f"CASE WHEN regexp_matches(lower(concat({QUERY_LEAD}, text)), {qt(_EXPLORE)}) THEN 'exploratory' ELSE 'factual' END AS kind FROM benchmark)",
    "clean_answers": with_answers(
        "SELECT answer_id, " + sql_strip("answer || '   [' || chr(10) || chr(10) || 'tail'") + " AS answer FROM answers"),
    "transcript_chunks": (
        f"WITH u AS (SELECT {_SEGMENT['source']} AS source, CAST({_SEGMENT['start']} AS DOUBLE) AS s, CAST({_SEGMENT['end']} AS DOUBLE) AS e, text FROM conversations) "
        "SELECT source, 'Timestamp ' || printf('%02d', floor(s / 60)::BIGINT) || ':' || printf('%02d', floor(s % 60)::BIGINT) || ' - ' || "
        f"printf('%02d', floor(e / 60)::BIGINT) || ':' || printf('%02d', floor(e % 60)::BIGINT) AS location, {sql_strip('text')} AS content FROM u WHERE {sql_strip('text')} <> ''"),
    "clean_ocr_lines": "SELECT doc_id, " + sql_scrub(
        f"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\. ', chr(10), 'g'), chr(10)), lambda l: {sql_strip('l')}), "
          f"lambda l: length(l) >= 10 AND len(regexp_extract_all(l, {qt(NWS + '+')})) >= 2), chr(10))") + " AS content FROM documents",
    "relevance_gate": f"SELECT doc_id, len(list_filter(regexp_extract_all(text, {qt(NWS + '+')}), lambda w: length(w) > 3)) >= 20 AS kept FROM documents",
    "density_route": (
        "WITH i AS (SELECT page_id, " + ", ".join(f"{e} AS {c}" for c, e in _IMAGES.items()) + " FROM pages), "
        "x AS (SELECT *, least(1.0::DOUBLE, chars * 150.0::DOUBLE / greatest(width * height, 1)) AS density FROM i) SELECT page_id, round(density, 6) AS density, "
        "CASE WHEN density >= 0.40 AND confidence >= 60 THEN 'image_ocr' WHEN density >= 0.20 THEN 'image_hybrid' ELSE 'image_vision' END AS route FROM x"),
    "image_chunks": (
        "WITH i AS (SELECT page_id, " + ", ".join(f"{e} AS {c}" for c, e in _IMAGES.items()) + " FROM pages), "
        "x AS (SELECT *, least(1.0::DOUBLE, chars * 150.0::DOUBLE / greatest(width * height, 1)) AS density, "
        + sql_strip("replace(ocr, '/', ' ')") + " AS line FROM i), "
        f"y AS (SELECT *, CASE WHEN length(line) >= 10 AND len(regexp_extract_all(line, {qt(NWS + '+')})) >= 2 THEN {sql_scrub('line')} ELSE '' END AS t, "
        f"CASE WHEN len(list_filter(regexp_extract_all(description, {qt(NWS + '+')}), lambda w: length(w) > 3)) >= 20 THEN {sql_scrub('description')} ELSE '' END AS v, "
        "CASE WHEN density >= 0.40 AND confidence >= 60 THEN 'image_ocr' WHEN density >= 0.20 THEN 'image_hybrid' ELSE 'image_vision' END AS route FROM x), "
        "z AS (SELECT *, CASE route WHEN 'image_ocr' THEN t WHEN 'image_vision' THEN v ELSE concat_ws(chr(10) || chr(10), "
        "CASE WHEN t <> '' THEN '[Text content]' || chr(10) || t END, CASE WHEN v <> '' THEN '[Visual content]' || chr(10) || v END) END AS body FROM y) "
        "SELECT source, 'Page ' || (page + 1) || ', Image ' || (image + 1) AS location, CASE WHEN body <> '' THEN body ELSE '[' || source || "
        "']: no text could be extracted from this image; neither the OCR nor the vision model returned content. Indexed as a placeholder.' END AS content, "
        "CASE WHEN body <> '' THEN route ELSE 'image_empty' END AS content_type FROM z"),
    "scanned_pages": f"SELECT page_id, length({sql_strip('''regexp_replace(html, '(?s)<[^>]*>', '', 'g')''')}) < 100 AND length(html) * 64 / 1024 > 100 AS scanned FROM pages",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END AS tool_result, "
                     "CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS slice, substr(text, 1, 512) AS pair FROM documents",
    "extract_ids": with_answers(
        f"SELECT answer_id, unnest(range(len(x))) AS pos, unnest(x) AS item FROM (SELECT answer_id, regexp_extract_all({_ascii('answer')}, {qt(SPECIFIC_RX)}) AS x FROM answers)"),
    "thread_chunks": (
        "WITH t AS (SELECT conv_id AS thread_id, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS body, "
        "'[#room-' || conv_id % 7 || ' / ' || arg_min(role, turn) || ' / 2024-01-0' || (1 + conv_id % 9) || ']' || chr(10) AS head "
        "FROM conversations GROUP BY conv_id), u AS (SELECT *, CASE WHEN length(body) > 800 THEN 600 ELSE 800 END AS unit FROM t), "
        "p AS (SELECT *, unnest(range(1, CAST(ceil(length(body) / unit) AS BIGINT) + 1)) AS piece FROM u) "
        "SELECT thread_id, piece, head || substr(body, (piece - 1) * unit + 1, unit) AS content FROM p"),
    "mail_chunks": "SELECT conv_id, turn, 'Email from: ' || role || '@example.org' || chr(10) || 'Subject: Conversation ' || conv_id || chr(10) || chr(10) || text AS content "
                   "FROM conversations",
    "embedding_prompts": "SELECT item_id, 'search_query: ' || text AS prompt FROM benchmark",
    "route_files": (
        f"WITH {_KEYS_SQL} SELECT key, ext, list_contains({_EXTS}, ext) AS allowed, "
        f"CASE WHEN ext IN {_exts(fixed.CODE_EXTS)} THEN 'code' WHEN ext IN {_exts(fixed.TEXT_EXTS)} THEN 'document' WHEN ext IN ('.pdf', '.docx') THEN 'paged' "
        f"WHEN ext IN {_exts(fixed.IMAGE_EXTS)} THEN 'image' WHEN ext IN {_exts(fixed.VIDEO_EXTS)} THEN 'video' WHEN ext IN {_exts(fixed.AUDIO_EXTS)} THEN 'audio' "
        "ELSE 'unsupported' END AS handler, CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) ELSE 'general' END AS category, "
        "'local://' || key AS source, 's3://kb/' || key AS object, "
        "CASE WHEN ext = '' THEN lower(regexp_extract(key, '[^/]*$')) ELSE lower(substr(regexp_extract(key, '[^/]*$'), 1, length(regexp_extract(key, '[^/]*$')) - length(ext))) END AS stem FROM ex"),
    "folder_scan": f"WITH {_KEYS_SQL} SELECT CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) ELSE 'general' END AS category, "
                   f"count(DISTINCT key) AS files FROM ex WHERE {_USER_FILE} GROUP BY 1",
    "folder_read": f"SELECT name AS key, md5(rtrim(text, chr(10))) AS text, 64 AS n FROM (SELECT {_FOLDER_NAME} AS name, text FROM benchmark) WHERE NOT starts_with(name, '__') AND NOT ends_with(name, '.exe')",
    "upload_intake": f"WITH {_KEYS_SQL} SELECT doc_id, CASE WHEN NOT list_contains({_EXTS}, ext) THEN 'unsupported type' "
                     "WHEN n_chars <= 500 THEN 'no text' ELSE 'accepted' END AS result FROM ex",
    "drop_blank": f"SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' AND {sql_strip('text')} <> '' GROUP BY role",
    "valid_questions": f"SELECT conv_id, turn, length(q) AS n FROM (SELECT conv_id, turn, {sql_strip('text')} AS q "
                       "FROM conversations UNION ALL SELECT conv_id, turn, substr(role, 1, 1 + turn % 8) FROM conversations) WHERE length(q) >= 3",
    "top_k_clamps": "SELECT conv_id, turn, greatest(1, least(k, 8)) AS query, greatest(1, least(k, 20)) AS search, greatest(1, least(k, 200)) AS activity, "
                    "greatest(1, least(k, 5)) AS iterations FROM (SELECT conv_id, turn, length(text) - 60 AS k FROM conversations)",
}
