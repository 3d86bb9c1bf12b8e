"""Registered queries: inventory, lookups and scoping over the chunk index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.toolcalls import tool_calls
from docquarry.functions.vectors import is_usable
from docquarry.operators import catalog
from docquarry.plans import tools
from docquarry.registry.retrieval import ORACLES as RETRIEVAL
from docquarry.registry.views import FILE_NO, INDEX_COLUMNS, QUESTIONS_SQL, index_chunks, n_vectors, table, with_index
from docquarry.session import persist_table, shared_dir
from docquarry.sources import tables as tb

_ACL = [
    "doc_id", "lang",
    "CASE WHEN doc_id % 5 = 0 THEN 'public' WHEN doc_id % 5 < 4 THEN 'team' END AS visibility",
    "CASE WHEN toxic = 1 THEN {a}'ann@acme.org', source{z} WHEN toxic = 0 THEN {a}source{z} END AS users",
    "CASE WHEN quality = 1 THEN {a}'acme.org'{z} ELSE {a}'other.org'{z} END AS {q}groups{q}",
]


def q_tenant_scope(s, d):
    return catalog.tenant_scope(index_chunks(s, d), "tenant-a").select("id", "source", "category")


def q_acl_visible(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").selectExpr(
        *[e.format(a="array(", z=")", q="`") for e in _ACL])
    return catalog.acl_visible(rows, "ann@acme.org").select("doc_id", "lang")


def q_list_files(s, d):
    return catalog.list_files(index_chunks(s, d))


def q_list_files_category(s, d):
    return catalog.list_files(index_chunks(s, d), "multimedia")


def q_index_status(s, d):
    return catalog.index_status(index_chunks(s, d))


def q_index_totals(s, d):
    """Two batches of one index: totals merged from their sketches, next to whether the estimate is within 3 %."""
    chunks = index_chunks(s, d)
    rows = chunks.select("source", "category", "content", (F.col("id") % 2).cast("int").alias("half"), F.lit("t").alias("tenant_id"))
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in tb.CHUNKS.split(", ")
             if c.split()[0] not in ("source", "category", "content", "tenant_id", "batch")]
    tables = tb.BatchTables(s, shared_dir(s, "totals"))
    for batch in (0, 1):
        tables.write("chunks", rows.filter(F.col("half") == batch).select("*", *empty), batch)
    exact = tables.read("chunks").groupBy("category").agg(F.countDistinct("source").alias("n"))
    near = F.abs(F.col("sources") - F.col("n")) <= F.greatest(F.lit(1.0), 0.03 * F.col("n"))
    return tables.totals("category").join(exact, "category").select("category", "chunks", F.col("n").alias("sources"), near.alias("near"))


def q_chunks_by_type(s, d):
    return catalog.chunks_by_type(index_chunks(s, d))


def q_chunk_preview(s, d):
    return catalog.chunk_preview(index_chunks(s, d))


# Requests come from documents: right ones, ones with only the file name in other
# case, ones with a made-up folder, ones without any counterpart.
_REQUEST = {
    "request_id": "doc_id",
    "source": "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN {own} WHEN 1 THEN concat('local://lost/DOC-', CAST({no} AS VARCHAR(20)), '.md') "
              "WHEN 2 THEN concat('c-', CAST({no} AS VARCHAR(20)), '.md') ELSE concat('nothing-', lang, CAST(n_chars AS VARCHAR(20))) END",
    "location": "CASE WHEN doc_id % 8 = 0 THEN 'Section 9' ELSE concat('Section ', CAST(doc_id % 3 + 1 AS VARCHAR(20))) END",
}


def _request_exprs() -> list[str]:
    return [f"{e.format(own=INDEX_COLUMNS['source'], no=FILE_NO) if '{' in e else e} AS {c}" for c, e in _REQUEST.items()]


def _requests(s, d):
    return table(s, d, "documents").selectExpr(*_request_exprs())


_REQUESTS_SQL = "req AS (SELECT " + ", ".join(_request_exprs()) + " FROM documents)"
_FNAME = "lower(ltrim(regexp_extract(r.source, '[^/]*$'), '/'))"
_PICK_SQL = (
    _REQUESTS_SQL + ", srcs AS (SELECT source, min(id) AS id FROM idx GROUP BY source), picks AS ("
    "SELECT r.request_id, 1 AS stage, min(c.id) AS id FROM req r JOIN idx c ON c.source = r.source AND c.location = r.location GROUP BY 1 "
    f"UNION ALL SELECT r.request_id, 2, min(c.id) FROM req r JOIN srcs c ON {_FNAME} <> '' AND ends_with(lower(c.source), {_FNAME}) GROUP BY 1), "
    "pick AS (SELECT request_id, min(stage) AS stage, arg_min(id, stage) AS id FROM picks GROUP BY 1)"
)


def q_read_chunk(s, d):
    got = catalog.read_chunk(_requests(s, d), index_chunks(s, d))
    return got.select("request_id", "found", "stage", "id", "source", "location", "category", F.md5("content").alias("content"))


def q_suffix_match(s, d):
    r = _requests(s, d)
    return catalog.by_suffix(r, catalog.files_of(index_chunks(s, d))).groupBy("request_id").agg(
        F.count("*").alias("files"), F.min("id").alias("first_id"))


def q_compare_sections(s, d):
    r = _requests(s, d)
    pairs = r.select("request_id", F.col("source").alias("source_a"), F.col("location").alias("location_a"),
                     F.concat(F.lit("local://products/doc-"), (F.col("request_id") / 3).cast("bigint"), F.lit(".md")).alias("source_b"),
                     F.lit("Section 2").alias("location_b"))
    got = catalog.compare_sections(pairs, index_chunks(s, d))
    return got.select("request_id", "source_a", "location_a", F.md5("content_a").alias("content_a"),
                      "source_b", "location_b", F.md5("content_b").alias("content_b"))


def q_document_sections(s, d):
    merged = index_chunks(s, d).withColumn("location", F.when(F.col("id") % 3 == 2, "Section 1").otherwise(F.col("location")))
    return catalog.document_sections(merged).select("source", "location", "id", F.md5("content").alias("content"))


def q_resolve_document(s, d):
    return catalog.resolve_document(_requests(s, d), index_chunks(s, d))


def q_summarize_document(s, d):
    got = tools.summarize_document(_requests(s, d), index_chunks(s, d))
    return got.select("request_id", "source", "location", "id", F.md5("content").alias("content"))


_SEARCHED = f"concat('compare the notes in ', lang, ' on doc-', CAST({FILE_NO} AS VARCHAR(20)))"
_CALLS = (
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('read_chunk(source=\"', {source}, '\", location=\"', {location}, '\")') "
    "WHEN 1 THEN concat('summarize_document(source=', {source}, ')') WHEN 2 THEN concat('list_files(category=', {category}, ')') "
    "WHEN 3 THEN concat('compare_sections(source_a=\"', {source}, '\", location_a=\"', {location}, '\", source_b=\"', {source}, '\", location_b=\"Section 1\")') "
    "ELSE concat('search_documents(query=\"', {query}, '\", top_k=3)') END"
).replace("{source}", INDEX_COLUMNS["source"]).replace("{location}", INDEX_COLUMNS["location"]).replace("{category}", INDEX_COLUMNS["category"]).replace("{query}", _SEARCHED)


def q_tool_dispatch(s, d):
    """Calls written as text, parsed and answered by the five tools they name."""
    t = table(s, d, "documents").selectExpr("doc_id AS request_id", f"{_CALLS} AS content")
    # stored once: the tools would parse the calls, and join vectors to the texts, again in every pass
    calls = persist_table(tx.unroll(t, tool_calls(F.col("content")), "pos", "c", ["request_id"]).select("request_id", "c.tool", "c.args"), "calls")
    index = persist_table(index_chunks(s, d).drop("file_hash"), "index")

    def asked(tool: str, **types: str) -> DataFrame:
        return tools.calls_of(calls, tool, **types)

    vectors = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    search = asked("search_documents", query="string", top_k="int", category="string").withColumn("vec_id", F.col("request_id") % n_vectors(s, d)).join(vectors, "vec_id")
    item = {
        "read_chunk": (asked("read_chunk", source="string", location="string"), F.col("id").cast("string")),
        "summarize_document": (asked("summarize_document", source="string"), F.col("id").cast("string")),
        "list_files": (asked("list_files", category="string"), F.col("source")),
        "compare_sections": (asked("compare_sections", source_a="string", location_a="string", source_b="string", location_b="string"),
                             F.concat_ws("|", "source_a", "location_a", "source_b", "location_b", F.md5("content_a"), F.md5("content_b"))),
        "search_documents": (search, F.concat_ws(" ", "rank", "id")),
    }
    done = [tools.TOOLS[tool](requests, index).select("request_id", F.lit(tool).alias("tool"), value.alias("item")) for tool, (requests, value) in item.items()]
    return reduce(DataFrame.unionByName, done)


def q_json_role_lookup(s, d):
    users = table(s, d, "customer").selectExpr(
        "c_custkey AS id", "concat(lower(c_name), '@example.org') AS email",
        "concat('{\"role\": \"', lower(c_mktsegment), '\"}') AS raw_user_meta_data",
        "CASE WHEN c_acctbal > 9000 THEN '{\"role\": \"admin\", \"x\": 1}' ELSE '{}' END AS raw_app_meta_data")
    members = table(s, d, "supplier").selectExpr("s_suppkey AS id", "lower(s_name) AS email")
    return catalog.contact_of(users, members, "it@example.org")


def q_usable_chunks(s, d):
    return index_chunks(s, d).filter(is_usable(F.col("embedding"))).groupBy("category").agg(F.count("*").alias("n"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_TOK = "list_distinct(list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda t: length(t) >= 2))"

ORACLES = {
    "tenant_scope": with_index("SELECT id, source, category FROM idx WHERE tenant_id = 'tenant-a'"),
    "acl_visible": f"SELECT doc_id, lang FROM (SELECT {', '.join(e.format(a='[', z=']', q=chr(34)) for e in _ACL)} FROM documents LEFT JOIN labels USING (doc_id)) "
                   "WHERE coalesce(visibility, 'public') = 'public' OR list_contains(users, 'ann@acme.org') OR list_contains(\"groups\", 'acme.org')",
    "list_files": with_index("SELECT source, category, count(*) AS chunks, max(created_at) AS last_ingested FROM idx GROUP BY ALL"),
    "list_files_category": with_index(
        "SELECT source, category, count(*) AS chunks, max(created_at) AS last_ingested FROM idx WHERE category = 'multimedia' GROUP BY ALL"),
    "index_totals": with_index("SELECT category, count(*) AS chunks, count(DISTINCT source) AS sources, true AS near FROM idx GROUP BY category"),
    "index_status": with_index("SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM idx"),
    "chunks_by_type": with_index("SELECT coalesce(source_type, 'total') AS source_type, count(*) AS chunks FROM idx GROUP BY ROLLUP (source_type)"),
    "chunk_preview": with_index("SELECT id, source, substr(content, 1, 120) AS preview, length(content) AS n_chars FROM idx"),
    "read_chunk": with_index(
        f", {_PICK_SQL} SELECT r.request_id, c.id IS NOT NULL AS found, stage, c.id, c.source, c.location, c.category, md5(c.content) AS content "
        "FROM req r LEFT JOIN pick USING (request_id) LEFT JOIN idx c ON c.id = pick.id"),
    "suffix_match": with_index(
        f", {_PICK_SQL} SELECT r.request_id, count(*) AS files, min(c.id) AS first_id FROM req r JOIN srcs c ON {_FNAME} <> '' "
        f"AND ends_with(lower(c.source), {_FNAME}) GROUP BY 1"),
    "compare_sections": with_index(
        ", " + _PICK_SQL.replace(_REQUESTS_SQL, "base AS (SELECT " + ", ".join(_request_exprs()) + " FROM documents), "
        "req AS (SELECT request_id * 2 AS request_id, source, location FROM base UNION ALL "
        "SELECT request_id * 2 + 1, 'local://products/doc-' || (request_id // 3) || '.md', 'Section 2' FROM base)") +
        " SELECT request_id // 2 AS request_id, "
        + ", ".join(f"max(CASE WHEN request_id % 2 = {n} THEN {e} END) AS {f}_{side}" for n, side in ((0, "a"), (1, "b"))
                    for f, e in (("source", "c.source"), ("location", "c.location"), ("content", "md5(c.content)")))
        + " FROM req LEFT JOIN pick USING (request_id) LEFT JOIN idx c ON c.id = pick.id GROUP BY 1"),
    "document_sections": with_index(
        ", m AS (SELECT * REPLACE (CASE WHEN id % 3 = 2 THEN 'Section 1' ELSE location END AS location) FROM idx) "
        "SELECT source, location, id, md5(content) AS content FROM m QUALIFY row_number() OVER (PARTITION BY source, location ORDER BY id) = 1"),
    "resolve_document": with_index(
        f", {_REQUESTS_SQL}, srcs AS (SELECT source, min(id) AS id FROM idx GROUP BY source), "
        "wantmd AS (SELECT request_id, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.md$', '')) || '.md' AS w FROM req), "
        f"rt AS (SELECT request_id, {_TOK.format(x='lower(source)')} AS toks FROM req), "
        f"st AS (SELECT id, {_TOK.format(x='''regexp_replace(lower(regexp_extract(source, '[^/]*$')), '[.]md$', '')''')} AS toks FROM srcs), "
        "cand AS (SELECT r.request_id, 1 AS stage, 0 AS o, c.id FROM req r JOIN srcs c ON c.source = r.source "
        "UNION ALL SELECT w.request_id, 2, 0, c.id FROM wantmd w JOIN srcs c ON w <> '.md' AND ends_with(lower(c.source), w) "
        "UNION ALL SELECT rt.request_id, 3, -len(list_intersect(rt.toks, st.toks)), st.id FROM rt CROSS JOIN st "
        "WHERE len(list_intersect(rt.toks, st.toks)) >= 1), "
        "best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY stage, o, id) = 1) "
        "SELECT r.request_id, r.source AS requested, s.source, b.stage FROM req r LEFT JOIN best b USING (request_id) LEFT JOIN srcs s ON s.id = b.id"),
    "tool_dispatch": with_index(
        "SELECT id AS request_id, 'read_chunk' AS tool, id::VARCHAR AS item FROM idx WHERE id % 5 = 0 UNION ALL "
        "SELECT r.id, 'summarize_document', s.id::VARCHAR FROM idx r JOIN idx s ON s.source = r.source WHERE r.id % 5 = 1 UNION ALL "
        "SELECT r.id, 'list_files', s.source FROM idx r JOIN (SELECT DISTINCT category, source FROM idx) s ON s.category = r.category WHERE r.id % 5 = 2 UNION ALL "
        "SELECT a.id, 'compare_sections', concat_ws('|', a.source, a.location, b.source, b.location, md5(a.content), md5(b.content)) FROM idx a JOIN idx b "
        "ON b.source = a.source AND b.location = 'Section 1' WHERE a.id % 5 = 3 UNION ALL "
        "SELECT query_id, 'search_documents', rank || ' ' || id FROM (" + RETRIEVAL["search_documents"].replace(
            QUESTIONS_SQL, f"questions AS (SELECT doc_id AS query_id, {_SEARCHED} AS query, embedding AS query_vec, 3 AS top_k, NULL::VARCHAR AS category "
                           "FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) WHERE doc_id % 5 = 4)") + ")"),
    "json_role_lookup": "SELECT coalesce((SELECT lower(c_name) || '@example.org' FROM customer WHERE c_acctbal > 9000 OR lower(c_mktsegment) = 'admin' "
                        "ORDER BY c_custkey LIMIT 1), (SELECT lower(s_name) FROM supplier ORDER BY s_suppkey LIMIT 1), 'it@example.org') AS email",
    "usable_chunks": with_index("SELECT category, count(*) AS n FROM idx WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY category"),
}
ORACLES["summarize_document"] = ORACLES["resolve_document"].replace(
    "SELECT r.request_id, r.source AS requested, s.source, b.stage FROM req r LEFT JOIN best b USING (request_id) LEFT JOIN srcs s ON s.id = b.id",
    "SELECT b.request_id, c.source, c.location, c.id, md5(c.content) AS content FROM best b JOIN srcs s ON s.id = b.id JOIN idx c ON c.source = s.source")
