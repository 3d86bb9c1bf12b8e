"""Registered queries: sources, sinks, ingestion, streaming, tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.seams import embed_hashed
from docquarry.functions.toolcalls import tool_calls
from docquarry.plans import ingest
from docquarry.plans.retrieve import hybrid_retrieve
from docquarry.registry.evaluation import _EV_SQL, _evaluated
from docquarry.registry.retrieval import HYBRID_SQL
from docquarry.registry.texts import _CHUNK_SQL, _CODE_SQL, sql_scrub, sql_strip
from docquarry.registry.upkeep import NOW
from docquarry.registry.views import QUESTIONS_SQL, TENANT, index_chunks, n_vectors, questions, table, with_index
from docquarry.session import persist_table, shared_dir, spread
from docquarry.sources import audit, tables as tb
from docquarry.streaming import activity, objects, retries

# --- files made of documents: by language .md, .txt, .py, and .exe, which is not supported -----

_FILE_KEY = (
    "concat(source, '/doc-', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.exe' ELSE '.py' END)"
)
_FILE = {"tenant_id": TENANT, "key": _FILE_KEY, "source": f"concat('s3://kb/', {_FILE_KEY})", "file_hash": "md5(text)",
         "etag": "md5(text)", "size_bytes": "CAST({bytes}(text) AS BIGINT)", "text": "text"}


def _files(s, d) -> DataFrame:
    return spread(table(s, d, "documents"), "doc_id").selectExpr(*[f"{e.format(bytes='octet_length')} AS {c}" for c, e in _FILE.items()])


def _small_embed(df, text):
    return embed_hashed(df, text, dim=64)


def _tables(s, name) -> tb.BatchTables:
    return tb.BatchTables(s, shared_dir(s, name))


def q_ingest_files(s, d):
    rows = ingest.index_rows(_files(s, d), _small_embed)
    return rows.select("source", "source_type", "location", "category", F.md5("content").alias("content"), F.size("embedding").alias("dim"))


def q_ingest_batch(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").selectExpr(
        f"{TENANT} AS tenant_id", "md5(text) AS file_hash", f"concat('s3://kb/', {_FILE_KEY}) AS source")
    _, status = ingest.ingest_batch(_files(s, d), docs, _small_embed)
    return status


def _listing(f: DataFrame) -> DataFrame:
    return f.filter(tx.is_allowed(F.col("key"))).select("tenant_id", F.col("key").alias("s3_key"), "etag", "file_hash", "size_bytes")


def q_reconcile(s, d):
    """Two passes: labelled documents in their old state, then all documents as they are."""
    t = _tables(s, "reconcile")
    labels = table(s, d, "labels")
    old = table(s, d, "documents").join(labels, "doc_id").withColumn(
        "text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    gone = table(s, d, "benchmark").selectExpr(
        "item_id AS doc_id", "'en' AS lang", "'old' AS source", "text", "0 AS n_chars")
    before = old.select("doc_id", "lang", "source", "text").unionByName(gone.drop("n_chars")).selectExpr(
        *[f"{e.format(bytes='octet_length')} AS {c}" for c, e in _FILE.items()])
    now = F.expr(NOW)
    first = ingest.reconcile(t, _listing(before), before, 1, now, _small_embed)
    second = ingest.reconcile(t, _listing(_files(s, d)), _files(s, d), 2, now, _small_embed)
    live = t.live_chunks().agg(F.count("*").alias("live_chunks"), F.countDistinct("source").alias("live_sources"))
    one = first.select(F.lit(1).alias("pass"), "*").unionByName(second.select(F.lit(2).alias("pass"), "*"))
    return one.join(F.broadcast(live.withColumn("pass", F.lit(2))), "pass", "left")


def q_ingest_then_retrieve(s, d):
    """The engine searches what it has ingested: files to an index, its live chunks to answers. A file's chunks share the vector of its number."""
    n = n_vectors(s, d)
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")

    def embed(chunks: DataFrame, _: str) -> DataFrame:
        number = F.regexp_extract("key", r"doc-([0-9]+)", 1).cast("bigint") % n
        return chunks.withColumn("vec_id", number).join(vectors, "vec_id", "left").drop("vec_id")

    t, now = _tables(s, "searched"), F.expr(NOW)
    files = _files(s, d)
    stale = files.withColumn("text", F.concat(F.lit("stale "), "text")).withColumn("file_hash", F.md5("text")).withColumn("etag", F.md5("text"))
    ingest.reconcile(t, _listing(stale), stale, 1, now, embed)
    ingest.reconcile(t, _listing(files), files, 2, now, embed)
    return hybrid_retrieve(questions(s, d), t.live_chunks()).select(
        "query_id", "rank", "id", "source", "location", "semantic_score", F.round("score", 6).alias("score"))


def q_tick_reconcile(s, d):
    """A pass at every tick: first the labelled documents, then all, then all again."""
    t, ticks = _tables(s, "ticks"), shared_dir(s, "tick-files")
    files, labels = _files(s, d), table(s, d, "labels")
    some = table(s, d, "documents").join(labels, "doc_id", "left_semi").selectExpr(*[f"{e.format(bytes='octet_length')} AS {c}" for c, e in _FILE.items()])
    for i in range(3):
        s.range(i, i + 1).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.mode("append").text(ticks)
    seen = iter([some, files, files])

    def list_objects():
        now = next(seen)
        return _listing(now), now

    stream = s.readStream.option("maxFilesPerTrigger", 1).text(ticks)
    objects.start_reconcile(stream, list_objects, t, shared_dir(s, "ckpt"), embed=_small_embed, trigger={"availableNow": True}).awaitTermination()
    log = t.read("status").groupBy("batch").agg(*(F.count_if(F.col("status") == k).alias(k) for k in ("ok", "skipped", "failed")),
                                                F.sum(F.when(F.col("key").isNull(), F.col("chunks")).otherwise(0)).alias("unchanged"))
    return log.select(F.col("batch").alias("pass"), F.col("ok") + F.col("skipped") + F.col("failed"), "unchanged").toDF("pass", "changed", "unchanged")


def q_reconcile_tenants(s, d):
    """Two tenants with files of the same keys: each keeps its own texts, also when one of them deletes all of its files."""
    t = _tables(s, "tenants")
    one = _files(s, d).filter(tx.is_allowed(F.col("key"))).withColumn("tenant_id", F.lit("t-1"))
    two = one.withColumn("tenant_id", F.lit("t-2")).withColumn("text", F.concat("text", F.lit(" of two"))).withColumn("file_hash", F.md5("text")).withColumn("etag", F.md5("text"))
    both = one.unionByName(two)
    ingest.reconcile(t, _listing(both), both, 1, F.expr(NOW), _small_embed).collect()
    ingest.reconcile(t, _listing(two), two, 2, F.expr(NOW), _small_embed).collect()
    status = t.read("status").groupBy("tenant_id", "status").agg(F.sum(F.when(F.col("key").isNull(), F.col("chunks")).otherwise(1)).alias("n"))
    live = t.live_chunks().groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit("live chunks").alias("status"), "n")
    return status.unionByName(live)


_MEDIA = {
    "audio": ("conversations", "concat('calls/c', CAST(conv_id AS VARCHAR(20)), '.mp3')"),
    "paged": ("benchmark", "concat('papers/b', CAST(item_id AS VARCHAR(20)), '.pdf')"),
}


def q_ingest_media(s, d):
    """Conversations as recordings with transcripts, benchmark texts as pages."""
    base = "'t-1' AS tenant_id", "key", "concat('s3://kb/', key) AS source", "key AS file_hash", "9 AS size_bytes", "CAST(NULL AS STRING) AS text"
    calls = table(s, d, "conversations").selectExpr(f"{_MEDIA['audio'][1]} AS key", "struct(CAST(turn * 30 AS DOUBLE) AS start, CAST(turn * 30 + 20 AS DOUBLE) AS end, text) AS said")
    calls = calls.groupBy("key").agg(F.array_sort(F.collect_list("said")).alias("segments")).selectExpr(*base, "segments", "CAST(NULL AS ARRAY<STRING>) AS pages")
    papers = table(s, d, "benchmark").selectExpr(f"{_MEDIA['paged'][1]} AS key", "array(text) AS pages").selectExpr(
        *base, "CAST(NULL AS ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>) AS segments", "pages")
    rows = ingest.chunk_files(calls.unionByName(papers))
    return rows.select("source", "source_type", "location", "category", F.md5("content").alias("content"))


def q_stream_dead_letters(s, d):
    """Messages that cannot be read and objects that are not there, set aside by the stream."""
    inbox, t = shared_dir(s, "inbox"), _tables(s, "letters")
    table(s, d, "documents").selectExpr(f"{_BODY} AS body").write.text(inbox)
    files = _files(s, d).filter(tx.is_allowed(F.col("key")))
    stream = objects.read_object_events(s, inbox, files_per_trigger=10_000)
    objects.start_ingest(stream, lambda keys: files.join(keys, "key"), t, shared_dir(s, "ckpt"), embed=_small_embed,
                         trigger={"availableNow": True}).awaitTermination()
    return t.read("dead_letters").select("reason", F.when(F.col("reason") == "unreadable", F.md5("body")).otherwise(F.get_json_object("body", "$.key")).alias("what"))


# --- object events: every supported document once raw, once enveloped, some damaged ----------------

_BODY = (
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('{\"Records\":[{\"s3\":{\"bucket\":{\"name\":\"kb\"},\"object\":{\"key\":\"', {k}, '\",\"eTag\":\"', md5(text), '\"}}}]}') "
    "WHEN 1 THEN concat('{\"detail\":{\"bucket\":{\"name\":\"kb\"},\"object\":{\"key\":\"', {k}, '\"}}}') "
    "WHEN 2 THEN concat('{\"Records\":[{\"s3\":{\"bucket\":{\"name\":\"kb\"},\"object\":{\"key\":\"', replace({k}, '/', '%2F'), '\"}}},{\"s3\":{\"bucket\":{\"name\":\"kb\"},\"object\":{\"key\":\"extra/', CAST(doc_id AS VARCHAR(20)), '.md\"}}},{\"s3\":{\"bucket\":{\"name\":\"kb\"},\"object\":{}}}]}') "
    "WHEN 3 THEN concat('{\"detail\":{\"bucket\":{\"name\":\"kb\"},\"object\":{\"key\":\"', {k}) "
    "ELSE '{\"Records\":[]}' END"
).replace("{k}", _FILE_KEY)


def q_parse_object_events(s, d):
    messages = table(s, d, "documents").selectExpr("doc_id", f"{_BODY} AS body")
    good, bad = objects.parse_object_events(messages)
    return good.select("doc_id", "bucket", "key", "etag").unionByName(
        bad.select("doc_id", F.lit(None).cast("string").alias("bucket"), F.lit("unreadable").alias("key"),
                   F.lit(None).cast("string").alias("etag")))


def q_parse_first_record(s, d):
    messages = table(s, d, "documents").selectExpr("doc_id", f"{_BODY} AS body")
    return objects.parse_object_events(messages, first_only=True)[0].select("doc_id", "bucket", "key")


def q_stream_ingest(s, d):
    """Every document's event delivered twice through a stream; the index holds each file once."""
    inbox, t = shared_dir(s, "inbox"), _tables(s, "stream")
    messages = table(s, d, "documents").selectExpr(f"concat('{{\"detail\":{{\"bucket\":{{\"name\":\"kb\"}},\"object\":{{\"key\":\"', {_FILE_KEY}, '\"}}}}}}') AS body")
    messages.write.mode("append").text(inbox)
    messages.write.mode("append").text(inbox)
    files = _files(s, d)

    def fetch(keys: DataFrame) -> DataFrame:
        return files.filter(tx.is_allowed(F.col("key"))).join(keys, "key")

    stream = objects.read_object_events(s, inbox, files_per_trigger=10_000)
    q = objects.start_ingest(stream, fetch, t, shared_dir(s, "ckpt"), embed=_small_embed, trigger={"availableNow": True})
    q.awaitTermination()
    return t.live_chunks().groupBy("source").agg(F.count("*").alias("chunks"))


def q_stream_dedup(s, d):
    """First delivery per (user, type): repeats within the watermark are dropped."""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared_dir(s, "dedup")
    q = (objects.drop_redelivered(stream, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
         .writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(s, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.schema("user_id bigint, event_type string").parquet(out)


_OUTCOME = {
    "tenant_id": "concat('t-', CAST(user_id % 3 AS VARCHAR(20)))",
    "bucket": "CASE WHEN user_id % 2 = 0 THEN 'kb' ELSE 'archive' END",
    "key": "concat('doc-', CAST(user_id % 40 AS VARCHAR(20)), '.md')",
    "status": "CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'ok' END",
    "error": "concat(event_type, ' ', CAST(event_id AS VARCHAR(20)))",
}


def q_stream_retries(s, d):
    """Events as deliveries: three failures in a row within two days of each other make a dead letter."""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    outcomes = stream.selectExpr(*[f"{e} AS {c}" for c, e in _OUTCOME.items()], "CAST(ts AS TIMESTAMP) AS ts")
    out = shared_dir(s, "routes")
    retries.start_routing(outcomes, out, shared_dir(s, "ckpt"), limit=3, forget="2 days", trigger={"availableNow": True}).awaitTermination()
    return retries.read_routes(s, out).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def q_activity_windows(s, d):
    return activity.activity_windows(table(s, d, "events"))


def q_stream_activity(s, d):
    """The same windows, kept up by a stream."""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = shared_dir(s, "activity")
    activity.start_activity(stream, out, shared_dir(s, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    updates = s.read.schema("window_start timestamp, event_type string, n bigint, value double, epoch bigint").parquet(out)
    return activity.latest_windows(updates)


# --- audit --------------------------------------------------------------------------------------------

def _audit_columns():
    return audit.audit_entry(
        tenant_id=F.lit("t-1"), user_email=F.concat(F.lit("user"), "user_id", F.lit("@example.org")), query=F.col("event_type"),
        accessed=F.array(F.concat(F.lit("doc-"), "user_id", F.lit(".md")), F.lit("a.md"), F.lit("a.md")),
        at=F.col("ts").cast("timestamp"), citations=F.when(F.col("event_type") == "view", F.array(F.lit("a.md"))),
        refused=F.when(F.col("event_type") != "click", F.col("event_type") == "error"))


def q_audit_tail(s, d):
    e = table(s, d, "events")
    line = audit.audit_json(*_audit_columns())
    lines = e.select("event_id", F.when(F.col("value") > 90, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    return audit.audit_tail(lines, 200, F.col("event_id")).select(
        "event_id", "entry.timestamp", "entry.user_email", "entry.query", F.array_join("entry.accessed_files", ",").alias("files"),
        F.size("entry.citations").alias("n_citations"), "entry.refused")


def q_audit_roundtrip(s, d):
    path = shared_dir(s, "audit")
    audit.append_audit(table(s, d, "events").select(*_audit_columns()), path)
    return audit.read_audit(s, path).groupBy("query").agg(
        F.count("*").alias("n"), F.countDistinct("user_email").alias("users"),
        F.count_if(F.col("refused").isNotNull()).alias("with_flag"), F.count("citations").alias("with_citations"))


# --- sinks --------------------------------------------------------------------------------------------------

def q_index_roundtrip(s, d):
    path = shared_dir(s, "index")
    chunks = index_chunks(s, d).select("id", "source", "source_type", "location", "content", "embedding")
    hashes = index_chunks(s, d).groupBy("source").agg(F.min("file_hash").alias("hash"))
    tb.write_index(chunks, hashes, path, "json")
    back, known = tb.read_index(
        s, path, "id bigint, source string, source_type string, location string, content string, embedding array<float>",
        "source string, hash string", "json")
    return back.join(known, "source").select(
        "id", "source", "location", F.md5("content").alias("content"), F.size("embedding").alias("dim"), "hash")


def q_chunk_table(s, d):
    path = shared_dir(s, "chunks")
    tb.append_chunks(index_chunks(s, d), path)
    back = s.read.parquet(path)
    return back.groupBy("tenant_id", "category").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.min(F.md5("content")).alias("first_content"), F.sum(F.size("embedding")).alias("numbers"))


def q_clear_index(s, d):
    path = shared_dir(s, "clear")
    chunks = index_chunks(s, d)
    tb.replace_table(chunks, f"{path}/chunks")
    by_source = chunks.groupBy("tenant_id", F.col("source").alias("s3_key")).agg(
        F.min("file_hash").alias("file_hash"), F.count("*").alias("size_bytes"), F.max("created_at").alias("last_seen_at"))
    tb.replace_table(by_source, f"{path}/manifest")

    def sizes(column: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (s.read.parquet(f"{path}/{name}").agg(F.count("*").alias(column)).withColumn("name", F.lit(name)) for name in ("chunks", "manifest")))

    before = persist_table(sizes("before"), "before")
    tb.clear_index(s, f"{path}/chunks", f"{path}/manifest")
    return before.join(sizes("left").join(_column_counts(s, path, ("chunks", "manifest")), "name"), "name")


def _column_counts(s, path: str, names: tuple[str, ...]) -> DataFrame:
    return s.createDataFrame([(n, len(s.read.parquet(f"{path}/{n}").columns)) for n in names], "name string, columns int")


def q_eval_results(s, d):
    from docquarry.operators.evaluation import score_answers

    path = shared_dir(s, "results")
    scored = score_answers(_evaluated(s, d)).select("answer_id", "category", "ok", "reason", "citations")
    tb.write_results(scored, path)
    back = s.read.schema("answer_id bigint, category string, ok boolean, reason string, "
                         "citations array<struct<source:string,location:string>>").json(path)
    return back.select("answer_id", "category", "ok", "reason")


# --- tool calls -----------------------------------------------------------------------------------------------

_CALL_TEXT = (
    "CASE CAST(turn % 3 AS INT) WHEN 0 THEN concat('I call search_documents(query=\"turn ', CAST(conv_id AS VARCHAR(20)), ', or so\", top_k=', CAST(turn AS VARCHAR(20)), ') first. ', {t}) "
    "WHEN 1 THEN concat({t}, ' [{\"name\": \"read_chunk\", \"arguments\": {\"source\": \"doc-', CAST(conv_id AS VARCHAR(20)), '.md\", \"location\": \"Section 1\"}}] ') "
    "ELSE concat('compare_sections(source_a=a.md, source_b=''b, c.md'', strict=True) and list_files() ', {t}) END"
).replace("{t}", "translate(text, '()[]{}', '')")


def q_tool_calls(s, d):
    t = table(s, d, "conversations").selectExpr("conv_id", "turn", f"{_CALL_TEXT} AS content")
    c = tx.unroll(t, tool_calls(F.col("content")), "pos", "c", ["conv_id", "turn"])
    return c.select("conv_id", "turn", "pos", "c.tool", F.array_join(
        F.transform(F.array_sort(F.map_entries("c.args")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("args"))


def q_hashed_embeddings(s, d):
    e = embed_hashed(table(s, d, "benchmark"), "text", dim=64)
    from docquarry.functions.vectors import norm

    return e.select("item_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 3).alias("length"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_F_SQL = "f AS (SELECT doc_id, lang, " + ", ".join(f"{e.format(bytes='strlen')} AS {c}" for c, e in _FILE.items()) + " FROM documents)"
_TEXT_CHUNKS = _CHUNK_SQL.replace("FROM documents", "FROM texts_in")
_RAW_CODE = _CODE_SQL.replace(
    _CODE_SQL[_CODE_SQL.index("FROM (SELECT doc_id, regexp_replace("):_CODE_SQL.index("),\nwalk AS")],
    "FROM (SELECT doc_id, text AS t FROM code_in)")


def _cut_sql(source: str, name: str) -> str:
    """Chunks of the files of ``source`` (doc_id, key, text, …) as ``name``."""
    text = _TEXT_CHUNKS.strip().removeprefix("WITH RECURSIVE").replace("texts_in", f"(SELECT * FROM {source} WHERE regexp_matches(key, '\\.(md|txt)$'))")
    code = _RAW_CODE.strip().removeprefix("WITH RECURSIVE").replace("code_in", f"(SELECT * FROM {source} WHERE ends_with(key, '.py'))")
    return (f"{name} AS (SELECT doc_id, 'document' AS source_type, 'Section ' || section AS location, content FROM (WITH RECURSIVE {text}) "
            f"UNION ALL SELECT doc_id, 'code', 'Block ' || block, content FROM (WITH RECURSIVE {code}))")


_WORDY = "regexp_matches(content, '[\\p{L}\\p{N}_]')"


_PER_FILE = (
    f"WITH {_F_SQL}, {_cut_sql('f', 'cut')}, n AS (SELECT doc_id, count(*) AS chunks FROM cut WHERE {_WORDY} GROUP BY doc_id) "
)
_OLD_SQL = (
    "olds AS (SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN text || ' old' ELSE text END AS text FROM documents JOIN labels USING (doc_id) "
    "UNION ALL SELECT item_id, 'en', 'old', text FROM benchmark), "
    "old AS (SELECT " + ", ".join(f"{e.format(bytes='strlen')} AS {c}" for c, e in _FILE.items()) + " FROM olds)"
)

_ID_JSON = (
    "'{\"tenant_id\":\"' || f.tenant_id || '\",\"source\":\"' || f.source || '\",\"file_hash\":\"' || f.file_hash || '\",\"location\":\"' || location || '\",\"place\":0}'"
)

ORACLES = {
    "ingest_then_retrieve": (
        f"WITH {_F_SQL}, {_cut_sql('f', 'cut')}, idx AS (SELECT substr(sha256({_ID_JSON}), 1, 32) AS id, f.source, source_type, location, {sql_scrub('content')} AS content, "
        "split_part(f.key, '/', 1) AS category, embedding FROM cut JOIN f USING (doc_id) JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)), "
        f"{QUESTIONS_SQL}, {HYBRID_SQL} SELECT query_id, rank, id, source, location, semantic_score, round(score, 6) AS score FROM hybrid"),
    "ingest_files": (
        f"WITH {_F_SQL}, {_cut_sql('f', 'cut')} SELECT f.source, source_type, location, split_part(f.key, '/', 1) AS category, md5({sql_scrub('content')}) AS content, 64 AS dim "
        f"FROM cut JOIN f USING (doc_id) WHERE {_WORDY}"),
    "ingest_batch": _PER_FILE + (
        "SELECT f.source, CASE WHEN ends_with(key, '.exe') THEN 'skipped' WHEN f.doc_id IN (SELECT doc_id FROM labels) THEN 'unchanged' "
        "WHEN chunks > 0 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN ends_with(key, '.exe') OR f.doc_id IN (SELECT doc_id FROM labels) THEN 0 "
        "ELSE coalesce(chunks, 0) END AS chunks FROM f LEFT JOIN n USING (doc_id)"),
    "reconcile": _PER_FILE.rstrip() + (
        f", {_OLD_SQL}, o AS (SELECT * FROM old WHERE NOT ends_with(key, '.exe')), l AS (SELECT * FROM f WHERE NOT ends_with(key, '.exe')), "
        "j AS (SELECT o.key AS ok, l.key AS lk, o.file_hash AS oh, l.file_hash AS lh FROM l FULL JOIN o ON o.key = l.key) "
        "SELECT 1 AS \"pass\", (SELECT count(*) FROM o) AS scanned, (SELECT count(*) FROM o) AS new, 0 AS changed, 0 AS deleted, 0 AS unchanged, "
        "NULL AS live_chunks, NULL AS live_sources UNION ALL SELECT 2, count(lk), count(*) FILTER (ok IS NULL), count(*) FILTER (oh <> lh), "
        "count(*) FILTER (lk IS NULL), count(*) FILTER (oh = lh), (SELECT sum(chunks) FROM n), (SELECT count(*) FROM n) FROM j"),
    "tick_reconcile": (
        f"WITH {_F_SQL}, l AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM f WHERE NOT ends_with(key, '.exe')) "
        "SELECT 0 AS \"pass\", count(*) FILTER (known) AS changed, 0 AS unchanged FROM l UNION ALL "
        "SELECT 1, count(*) FILTER (NOT known), count(*) FILTER (known) FROM l UNION ALL SELECT 2, 0, count(*) FROM l"),
    "reconcile_tenants": (
        f"WITH {_F_SQL}, both_files AS (SELECT doc_id * 2 AS doc_id, key, text FROM f UNION ALL SELECT doc_id * 2 + 1, key, text || ' of two' FROM f), "
        f"{_cut_sql('both_files', 'cut')}, n AS (SELECT doc_id, count(*) AS chunks FROM cut WHERE {_WORDY} GROUP BY doc_id), "
        f"a AS (SELECT b.doc_id % 2 AS two, chunks FROM both_files b LEFT JOIN n USING (doc_id) WHERE NOT ends_with(key, '.exe')) "
        f"SELECT CASE two WHEN 0 THEN 't-1' ELSE 't-2' END AS tenant_id, CASE WHEN chunks > 0 THEN 'ok' ELSE 'skipped' END AS status, count(*) AS n FROM a GROUP BY ALL "
        f"UNION ALL SELECT 't-1', 'deleted', count(*) FROM a WHERE two = 0 UNION ALL SELECT 't-2', 'unchanged', count(*) FROM a WHERE two = 1 "
        "UNION ALL SELECT 't-2', 'live chunks', sum(chunks)::BIGINT FROM a WHERE two = 1"),
    "ingest_media": (
        f"WITH p AS (SELECT item_id AS doc_id, {_MEDIA['paged'][1]} AS pkey, 'x.txt' AS key, text FROM benchmark), {_cut_sql('p', 'cut')} "
        f"SELECT 's3://kb/' || pkey AS source, 'document' AS source_type, 'Page 1' AS location, 'papers' AS category, md5({sql_scrub('content')}) AS content "
        "FROM cut JOIN p USING (doc_id) UNION ALL "
        f"SELECT 's3://kb/' || {_MEDIA['audio'][1]}, 'audio', 'Timestamp ' || lpad((turn * 30 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 30 % 60)::VARCHAR, 2, '0') || ' - ' || "
        "lpad(((turn * 30 + 20) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 30 + 20) % 60)::VARCHAR, 2, '0'), 'calls', "
        f"md5({sql_scrub(sql_strip('text'))}) FROM conversations WHERE {sql_strip('text')} <> ''"),
    "stream_dead_letters": (
        f"SELECT 'unreadable' AS reason, md5({_BODY}) AS what FROM documents WHERE doc_id % 5 >= 3 UNION ALL "
        f"SELECT 'not fetched', {_FILE_KEY} FROM documents WHERE doc_id % 5 < 3 AND lang = 'de' UNION ALL "
        "SELECT 'not fetched', 'extra/' || doc_id || '.md' FROM documents WHERE doc_id % 5 = 2 UNION ALL "
        "SELECT 'unreadable', md5('{\"Records\":[{\"s3\":{\"bucket\":{\"name\":\"kb\"},\"object\":{}}}]}') FROM documents WHERE doc_id % 5 = 2"),
    "parse_object_events": (
        f"SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'kb' END AS bucket, CASE WHEN doc_id % 5 < 3 THEN {_FILE_KEY} ELSE 'unreadable' END AS key, "
        "CASE WHEN doc_id % 5 = 0 THEN md5(text) END AS etag FROM documents UNION ALL "
        "SELECT doc_id, 'kb', 'extra/' || doc_id || '.md', NULL FROM documents WHERE doc_id % 5 = 2 UNION ALL "
        "SELECT doc_id, NULL, 'unreadable', NULL FROM documents WHERE doc_id % 5 = 2"),
    "parse_first_record": f"SELECT doc_id, 'kb' AS bucket, CASE WHEN doc_id % 5 = 2 THEN replace({_FILE_KEY}, '/', '%2F') ELSE {_FILE_KEY} END AS key FROM documents WHERE doc_id % 5 < 3",
    "stream_ingest": _PER_FILE + "SELECT source, chunks FROM n JOIN f USING (doc_id)",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_retries": (
        "WITH e AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _OUTCOME.items()) + ", ts FROM events), "
        "o AS (SELECT *, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS gap FROM e WINDOW w AS (PARTITION BY tenant_id, bucket, key ORDER BY ts, status, error)), "
        "i AS (SELECT *, sum(CASE WHEN status <> 'failed' OR gap > 172800000 THEN 1 ELSE 0 END) OVER w AS island FROM o "
        "WINDOW w AS (PARTITION BY tenant_id, bucket, key ORDER BY ts, status, error ROWS UNBOUNDED PRECEDING)), "
        "f AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id, bucket, key, island ORDER BY ts, error) - 1) % 3 + 1 AS attempts FROM i WHERE status = 'failed') "
        "SELECT tenant_id, bucket, key, attempts::INT AS attempts, CASE WHEN attempts = 3 THEN 'dead_letter' ELSE 'retry' END AS route, error, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM f"),
    "activity_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "stream_activity": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "audit_tail": (
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'user' || user_id || '@example.org' AS user_email, event_type AS query, "
        "'a.md,doc-' || user_id || '.md' AS files, CASE WHEN event_type = 'view' THEN 1 ELSE NULL END AS n_citations, "
        "CASE WHEN event_type <> 'click' THEN event_type = 'error' END AS refused FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) WHERE value <= 90"),
    "audit_roundtrip": "SELECT event_type AS query, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type <> 'click') AS with_flag, "
                       "count(*) FILTER (event_type = 'view') AS with_citations FROM events GROUP BY 1",
    "index_roundtrip": with_index(
        ", h AS (SELECT source, min(file_hash) AS hash FROM idx GROUP BY source) SELECT id, source, location, md5(content) AS content, len(embedding) AS dim, hash "
        "FROM idx JOIN h USING (source)"),
    "chunk_table": with_index("SELECT tenant_id, category, count(*) AS n, min(id) AS first_id, min(md5(content)) AS first_content, sum(len(embedding))::BIGINT AS numbers FROM idx GROUP BY ALL"),
    "eval_results": _EV_SQL + " SELECT answer_id, category, ok, reason FROM sc",
    "clear_index": with_index("SELECT 'chunks' AS name, count(*) AS before, 0 AS \"left\", 10 AS columns FROM idx UNION ALL "
                              "SELECT 'manifest', count(*), 0, 5 FROM (SELECT DISTINCT tenant_id, source FROM idx)"),
    "tool_calls": (
        "SELECT conv_id, turn, 0 AS pos, CASE turn % 3 WHEN 0 THEN 'search_documents' WHEN 1 THEN 'read_chunk' ELSE 'compare_sections' END AS tool, "
        "CASE turn % 3 WHEN 0 THEN 'query=turn ' || conv_id || ', or so;top_k=' || turn WHEN 1 THEN 'location=Section 1;source=doc-' || conv_id || '.md' "
        "ELSE 'source_a=a.md;source_b=b, c.md;strict=true' END AS args FROM conversations UNION ALL "
        "SELECT conv_id, turn, 1, 'list_files', '' FROM conversations WHERE turn % 3 = 2"),
    "hashed_embeddings": "SELECT item_id, 64 AS dim, 1.0::DOUBLE AS length FROM benchmark",
}
