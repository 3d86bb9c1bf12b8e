"""Registered queries: diffs, upserts, deletes, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import maintenance as mt
from docquarry.operators.catalog import recent_status
from docquarry.registry.views import TENANT, index_chunks, table, with_index

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_KEY = "concat(source, '/doc-', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'de' THEN '.exe' ELSE '.md' END)"
_ETAG = "CASE WHEN n_chars > 2000 THEN concat(md5(text), '-', CAST(n_chars AS VARCHAR(20))) ELSE md5(text) END"
_OBJECTS = [f"{_KEY} AS s3_key", f"{_ETAG} AS etag", "text AS content", "CAST({bytes}(text) AS BIGINT) AS size_bytes"]
# the manifest knows labelled documents, some in an older state, and objects that are gone
_OLD_ETAG = f"CASE WHEN toxic = 1 THEN concat('0', {_ETAG}) ELSE {_ETAG} END"
_OLD_HASH = "CASE WHEN quality = 0 AND n_chars > 2000 THEN 'stale' WHEN n_chars > 2000 THEN {sha}(text{arg}) ELSE md5(text) END"
_STAMPS = ["TIMESTAMP '2024-01-01 00:00:00' AS last_seen_at", "TIMESTAMP '2023-12-31 00:00:00' AS last_etag_at"]


def _objects(s, d) -> DataFrame:
    return table(s, d, "documents").selectExpr(*[e.format(bytes="octet_length") for e in _OBJECTS])


def _manifest(s, d) -> DataFrame:
    known = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").selectExpr(
        f"{_KEY} AS s3_key", f"{_OLD_ETAG} AS etag", f"{_OLD_HASH.format(sha='sha2', arg=', 256')} AS file_hash",
        "CAST(octet_length(text) AS BIGINT) AS size_bytes", *_STAMPS)
    gone = table(s, d, "benchmark").selectExpr(
        "concat('old/item-', item_id, '.md') AS s3_key", "md5(text) AS etag", "md5(text) AS file_hash",
        "CAST(octet_length(text) AS BIGINT) AS size_bytes", *_STAMPS)
    return known.unionByName(gone)


_SYNC_SQL = (
    f"listing AS (SELECT s3_key, etag, CASE WHEN contains(etag, '-') THEN sha256(content) ELSE etag END AS file_hash, size_bytes FROM "
    f"(SELECT {', '.join(e.format(bytes='strlen') for e in _OBJECTS)} FROM documents) WHERE NOT ends_with(s3_key, '.exe')), "
    f"manifest AS (SELECT {_KEY} AS s3_key, {_OLD_ETAG} AS etag, {_OLD_HASH.format(sha='sha256', arg='')} AS file_hash, strlen(text) AS size_bytes, {', '.join(_STAMPS)} "
    "FROM documents JOIN labels USING (doc_id) UNION ALL SELECT concat('old/item-', item_id, '.md'), md5(text), md5(text), strlen(text), "
    f"{', '.join(e.split(' AS ')[0] for e in _STAMPS)} FROM benchmark), "
    "diff AS (SELECT s3_key, CASE WHEN m.s3_key IS NULL THEN 'new' WHEN l.s3_key IS NULL THEN 'deleted' "
    "WHEN l.etag IS DISTINCT FROM m.etag OR l.file_hash IS DISTINCT FROM m.file_hash THEN 'changed' ELSE 'unchanged' END AS change, "
    "l.etag, l.file_hash, l.size_bytes FROM listing l FULL JOIN manifest m USING (s3_key))"
)


def q_object_listing(s, d):
    return mt.object_listing(_objects(s, d))


def q_manifest_diff(s, d):
    return mt.manifest_diff(mt.object_listing(_objects(s, d)), _manifest(s, d))


def q_sync_summary(s, d):
    return mt.sync_summary(q_manifest_diff(s, d))


def q_sync_changes(s, d):
    return q_manifest_diff(s, d).filter("change <> 'unchanged'").select("change", "s3_key")


def q_manifest_upsert(s, d):
    return mt.manifest_upsert(_manifest(s, d), mt.object_listing(_objects(s, d)), F.expr(NOW))


_BATCH = {"tenant_id": TENANT, "file_hash": "md5(text)", "source": _KEY, "chunks": "CAST(ceil(n_chars / 800.0) AS INT)"}
_BATCH_EXPRS = [f"{e} AS {c}" for c, e in _BATCH.items()]
_LEDGER_SOURCE = "min(CASE WHEN toxic = 1 THEN concat(source, '.moved') ELSE source END)"


def _batch(s, d):
    return table(s, d, "documents").selectExpr(*_BATCH_EXPRS)


def _ledger(s, d):
    known = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").selectExpr("toxic", *_BATCH_EXPRS)
    return known.groupBy("tenant_id", "file_hash").agg(
        F.expr(f"{_LEDGER_SOURCE} AS source"), F.max("chunks").alias("chunks")).selectExpr(
        "*", "TIMESTAMP '2024-01-01 00:00:00' AS ingested_at")


_LEDGER_SQL = (
    f"batch AS (SELECT {', '.join(_BATCH_EXPRS)} FROM documents), "
    f"known AS (SELECT toxic, b.* FROM (SELECT doc_id, {', '.join(_BATCH_EXPRS)} FROM documents) b JOIN labels USING (doc_id)), "
    f"ledger AS (SELECT tenant_id, file_hash, {_LEDGER_SOURCE} AS source, max(chunks) AS chunks, TIMESTAMP '2024-01-01 00:00:00' AS ingested_at "
    "FROM known GROUP BY ALL), "
    "one AS (SELECT tenant_id, file_hash, min(source) AS source, arg_min(chunks, source) AS chunks FROM batch GROUP BY ALL), "
    "acts AS (SELECT o.*, l.source AS known_source, CASE WHEN l.source IS NULL THEN 'insert' WHEN l.source = o.source THEN 'skip' ELSE 'update' END AS action "
    "FROM one o LEFT JOIN ledger l USING (tenant_id, file_hash))"
)


def q_ledger_new_files(s, d):
    return mt.ledger_new_files(_ledger(s, d), _batch(s, d))


def q_ledger_actions(s, d):
    return mt.ledger_actions(_ledger(s, d), _batch(s, d))


def q_ledger_upsert(s, d):
    return mt.ledger_upsert(_ledger(s, d), _batch(s, d), F.expr(NOW))


def q_changed_files(s, d):
    files = table(s, d, "documents").selectExpr("doc_id AS filename", "md5(text) AS hash")
    known = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").selectExpr(
        "doc_id AS filename", "CASE WHEN toxic = 1 THEN 'old' ELSE md5(text) END AS hash")
    return mt.changed_files(files, known).select("filename", "changed")


def _gone(s, d):
    # sources of documents that are labelled toxic
    from docquarry.registry.views import INDEX_COLUMNS

    return table(s, d, "documents").join(table(s, d, "labels").filter("toxic = 1"), "doc_id").selectExpr(
        f"{INDEX_COLUMNS['tenant_id']} AS tenant_id", f"{INDEX_COLUMNS['source']} AS source")


def q_delete_cascade(s, d):
    index = index_chunks(s, d)
    ledger = index.groupBy("tenant_id", "source", "file_hash").agg(F.count("*").alias("chunks"))
    manifest = index.select("tenant_id", F.col("source").alias("source_url")).distinct()
    rest, removed = mt.delete_cascade(
        _gone(s, d), chunks=(index, "source"), ledger=(ledger, "source"), manifest=(manifest, "source_url"))
    left = None
    for name, df in rest.items():
        n = df.agg(F.count("*").alias("left")).select(F.lit(name).alias("table"), "left")
        left = n if left is None else left.unionByName(n)
    return removed.join(left, "table")


def q_new_chunks_only(s, d):
    index = index_chunks(s, d).select("id", "source", "content")
    have = table(s, d, "labels").select(F.col("doc_id").alias("id"))
    return mt.new_chunks_only(index, index.join(have, "id", "left_semi")).select("id", "source")


def _status_log(s, d):
    return table(s, d, "events").selectExpr(
        "event_id", "concat('doc-', user_id, '.md') AS key",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unchanged' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status",
        "CAST(value AS INT) AS chunks", "CASE WHEN event_type = 'error' THEN concat('error ', CAST(value AS INT)) END AS error", "ts")


_STATUS_SQL = (
    "log AS (SELECT event_id, 'doc-' || user_id || '.md' AS key, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unchanged' "
    "WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status, CAST(trunc(value) AS INT) AS chunks, "
    "CASE WHEN event_type = 'error' THEN 'error ' || CAST(trunc(value) AS INT) END AS error, ts FROM events)"
)


def q_recent_status(s, d):
    return recent_status(_status_log(s, d)).select("event_id", "key", "status", "chunks", "error")


def q_recent_errors(s, d):
    return recent_status(_status_log(s, d), errors_only=True).select("event_id", "key", "error")


def q_ingest_summary(s, d):
    return mt.ingest_summary(_status_log(s, d))


def q_dead_letter(s, d):
    return mt.dead_letter(_status_log(s, d))


def q_provision_tenants(s, d):
    registry = table(s, d, "nation").selectExpr(
        "concat('t-', n_regionkey) AS tenant_id", "'Internal' AS name", "TIMESTAMP '2024-01-01 00:00:00' AS created_at").distinct()
    wanted = table(s, d, "customer").selectExpr("concat('t-', c_nationkey) AS tenant_id", "'Internal' AS name").distinct()
    return mt.provision_tenants(registry, wanted, F.expr(NOW))


def q_copy_tenant(s, d):
    copied = mt.copy_tenant(index_chunks(s, d), "tenant-a", "tenant-b")
    return copied.groupBy("tenant_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("id").alias("ids"), F.countDistinct("source").alias("sources"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

ORACLES = {
    "object_listing": f"WITH {_SYNC_SQL} SELECT * FROM listing",
    "manifest_diff": f"WITH {_SYNC_SQL} SELECT * FROM diff",
    "sync_summary": f"WITH {_SYNC_SQL} SELECT count(*) FILTER (change <> 'deleted') AS scanned, count(*) FILTER (change = 'new') AS new, "
                    "count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted, "
                    "count(*) FILTER (change = 'unchanged') AS unchanged FROM diff",
    "sync_changes": f"WITH {_SYNC_SQL} SELECT change, s3_key FROM diff WHERE change <> 'unchanged'",
    "manifest_upsert": (
        f"WITH {_SYNC_SQL} SELECT s3_key, CASE WHEN l.s3_key IS NULL THEN m.etag ELSE l.etag END AS etag, "
        "CASE WHEN l.s3_key IS NULL THEN m.file_hash ELSE l.file_hash END AS file_hash, "
        "CASE WHEN l.s3_key IS NULL THEN m.size_bytes ELSE l.size_bytes END AS size_bytes, "
        f"CASE WHEN l.s3_key IS NULL THEN m.last_seen_at ELSE {NOW} END AS last_seen_at, "
        f"CASE WHEN l.s3_key IS NULL OR l.etag = m.etag THEN m.last_etag_at ELSE {NOW} END AS last_etag_at "
        "FROM listing l FULL JOIN manifest m USING (s3_key)"),
    "ledger_new_files": f"WITH {_LEDGER_SQL} SELECT b.* FROM batch b ANTI JOIN ledger l USING (tenant_id, file_hash, source)",
    "ledger_actions": f"WITH {_LEDGER_SQL} SELECT * FROM acts",
    "ledger_upsert": (
        f"WITH {_LEDGER_SQL} SELECT tenant_id, file_hash, coalesce(a.source, l.source) AS source, coalesce(a.chunks, l.chunks) AS chunks, "
        f"CASE WHEN a.source IS NULL THEN l.ingested_at ELSE {NOW} END AS ingested_at FROM ledger l FULL JOIN "
        "(SELECT * FROM acts WHERE action <> 'skip') a USING (tenant_id, file_hash)"),
    "changed_files": "SELECT doc_id AS filename, coalesce(toxic = 1, true) AS changed FROM documents LEFT JOIN labels USING (doc_id)",
    "delete_cascade": with_index(
        ", gone AS (SELECT DISTINCT tenant_id || '/' || source FROM idx JOIN labels ON doc_id = id WHERE toxic = 1), "
        "own AS (SELECT tenant_id || '/' || source AS source, file_hash FROM idx), "
        "t AS (SELECT 'chunks' AS \"table\", source FROM own UNION ALL SELECT 'ledger', source FROM (SELECT DISTINCT source, file_hash FROM own) "
        "UNION ALL SELECT 'manifest', source FROM (SELECT DISTINCT source FROM own)) "
        "SELECT \"table\", count(*) FILTER (source IN (FROM gone)) AS removed, count(*) FILTER (source NOT IN (FROM gone)) AS \"left\" FROM t GROUP BY 1"),
    "new_chunks_only": with_index(
        ", fresh AS (SELECT * FROM idx i WHERE NOT EXISTS (SELECT 1 FROM idx j JOIN labels ON doc_id = j.id WHERE j.source = i.source AND j.content = i.content)) "
        "SELECT min(id) AS id, source FROM fresh GROUP BY source, content"),
    "recent_status": f"WITH {_STATUS_SQL} SELECT event_id, key, status, chunks, error FROM log ORDER BY ts DESC, event_id DESC LIMIT 50",
    "recent_errors": f"WITH {_STATUS_SQL} SELECT event_id, key, error FROM log WHERE error IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 50",
    "ingest_summary": f"WITH {_STATUS_SQL} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, "
                      "count(*) FILTER (status = 'failed') AS failed, sum(chunks) AS chunks FROM log",
    "dead_letter": (
        f"WITH {_STATUS_SQL}, g AS (SELECT key, count(*) FILTER (status = 'failed') AS attempts, arg_max(status, (ts, event_id)) AS last_status, "
        "arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS last_error FROM log GROUP BY key) "
        "SELECT *, CASE WHEN attempts >= 5 THEN 'dead_letter' ELSE 'retry' END AS route FROM g WHERE last_status = 'failed'"),
    "provision_tenants": (
        "WITH r AS (SELECT DISTINCT concat('t-', n_regionkey) AS tenant_id FROM nation), w AS (SELECT DISTINCT concat('t-', c_nationkey) AS tenant_id FROM customer) "
        "SELECT tenant_id, 'Internal' AS name, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM r UNION ALL "
        f"SELECT tenant_id, 'Internal', {NOW} FROM w ANTI JOIN r USING (tenant_id)"),
    "copy_tenant": with_index(
        "SELECT t AS tenant_id, count(*) AS chunks, count(DISTINCT id) AS ids, count(DISTINCT source) AS sources FROM idx, "
        "(VALUES ('tenant-a'), ('tenant-b')) v(t) WHERE tenant_id = 'tenant-a' GROUP BY t"),
}
