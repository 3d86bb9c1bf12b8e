"""Snapshots, lookups, sources, sinks and streams."""

from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions.seams import embed_hashed, embed_model
from docquarry.functions.toolcalls import split_arguments, tool_calls
from docquarry.operators import catalog, evaluation, maintenance as mt
from docquarry.plans import ingest, tools
from docquarry.sources import audit, files as src, tables as tb
from docquarry.streaming import activity, objects, retries

NOW = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
LIST = "s3_key string, etag string, file_hash string, size_bytes bigint"


def embed(df, text):
    return embed_hashed(df, text, dim=16)


def test_diff_table(spark):
    now = spark.createDataFrame([("new", "e", "h", 1), ("etag", "e2", "h", 1), ("hash", "e", "h2", 1), ("same", "e", "h", 1), ("nul", None, "h", 1)], LIST)
    old = spark.createDataFrame([("etag", "e", "h", 1), ("hash", "e", "h", 1), ("same", "e", "h", 1), ("gone", "e", "h", 1), ("nul", None, "h", 1)], LIST)
    diff = mt.manifest_diff(now, old)
    assert {r["s3_key"]: r["change"] for r in diff.collect()} == {
        "new": "new", "etag": "changed", "hash": "changed", "same": "unchanged", "gone": "deleted", "nul": "unchanged"}
    assert mt.sync_summary(diff).first().asDict() == {"scanned": 5, "new": 1, "changed": 2, "deleted": 1, "unchanged": 2}


def test_failed_listing_is_not_deleted(spark):
    now = spark.createDataFrame([("a", None, None, None, True)], LIST + ", listing_error boolean")
    old = spark.createDataFrame([("a", "e", "h", 1)], LIST)
    assert mt.manifest_diff(now, old).first()["change"] == "unknown"


def test_ledger_actions(spark):
    ledger = spark.createDataFrame([("t", "h1", "a", 3), ("t", "h2", "b", 4)], "tenant_id string, file_hash string, source string, chunks int")
    ledger = ledger.withColumn("ingested_at", F.expr("TIMESTAMP '2024-01-01 00:00:00'"))
    batch = spark.createDataFrame([("t", "h1", "a", 9), ("t", "h2", "c", 5), ("t", "h3", "d", 6), ("u", "h1", "a", 7)],
                                  "tenant_id string, file_hash string, source string, chunks int")
    acts = {(r["tenant_id"], r["file_hash"]): r["action"] for r in mt.ledger_actions(ledger, batch).collect()}
    assert acts == {("t", "h1"): "skip", ("t", "h2"): "update", ("t", "h3"): "insert", ("u", "h1"): "insert"}
    after = {(r["tenant_id"], r["file_hash"]): (r["source"], r["chunks"], r["ingested_at"].month) for r in mt.ledger_upsert(ledger, batch, NOW).collect()}
    assert after == {("t", "h1"): ("a", 3, 1), ("t", "h2"): ("c", 5, 2), ("t", "h3"): ("d", 6, 2), ("u", "h1"): ("a", 7, 2)}


def test_tenant_guard(spark):
    df = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    assert catalog.tenant_scope(df, "a").count() == 1
    with pytest.raises(Exception, match="another tenant"):
        catalog.assert_tenant(df, "a").collect()


def test_percentiles_match_exact(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("stage"), (F.sin("id") * 100 + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("ms"))
    want = {r["stage"]: (round(r[1][0], 4), round(r[1][1], 4)) for r in df.groupBy("stage").agg(F.percentile("ms", [0.5, 0.95])).collect()}
    got = {r["stage"]: (r["p50"], r["p95"]) for r in evaluation.latency_percentiles(df, "stage", cuts=20).collect()}
    assert len(got) == 7 and all(got[k] == pytest.approx(want[k]) for k in want)
    one = spark.createDataFrame([("a", 5.0)], "stage string, ms double")
    assert evaluation.latency_percentiles(one, "stage").first().asDict() == {"stage": "a", "n": 1, "p50": 5.0, "p95": 5.0}


def test_retrieval_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("r", 1, 10, 1), ("r", 1, 11, 2), ("r", 1, 12, 3), ("r", 2, 20, 4)], "run string, query_id int, doc int, rank int")
    qrels = spark.createDataFrame([("r", 1, 11), ("r", 1, 99), ("r", 2, 20), ("r", 3, 30)], "run string, query_id int, doc int")
    m = evaluation.retrieval_metrics(ranked, qrels, ["run"]).first()
    assert (m["n_queries"], m["recall_1"], m["recall_3"], m["recall_5"]) == (3, 0.0, 0.166667, 0.5)
    assert (m["mrr"], m["hit_3"], m["precision_5"]) == (0.25, 0.333333, 0.133333)


# --- files ----------------------------------------------------------------------------------

def write(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_folder_scan_and_text(spark, tmp_dir):
    for name, data in [("compliance/kyc.md", "Know your client."), ("top.txt", b"ok \xff\xfe bytes"), ("__init__.py", "x"), ("a/seed.py", "x"),
                       ("a/run.py", "print(1)"), ("a/pic.png", b"\x89"), ("a/skip.exe", b"x")]:
        write(tmp_dir, name, data)
    keys = {r["key"] for r in src.scan_folder(spark, tmp_dir, with_content=False).collect()}
    assert keys == {"compliance/kyc.md", "top.txt", "a/run.py", "a/pic.png"}
    texts = {r["key"]: r["text"] for r in src.read_texts(spark, tmp_dir).collect()}
    assert texts == {"compliance/kyc.md": "Know your client.", "top.txt": "ok  bytes", "a/run.py": "print(1)"}


def test_folder_to_index(spark, tmp_dir):
    write(tmp_dir, "compliance/kyc.md", "---\nkgf_permissions:\n  visibility: team\n---\nMail a@b.org about clients.")
    write(tmp_dir, "code/x.py", "def f():\n    return 1\n")
    files = src.read_texts(spark, tmp_dir).select(F.lit("t").alias("tenant_id"), "key", F.concat(F.lit("local://"), "key").alias("source"), "file_hash", "text")
    none = spark.createDataFrame([], "tenant_id string, file_hash string, source string")
    rows, status = ingest.ingest_batch(files, none, embed)
    got = {r["source"]: r for r in rows.collect()}
    assert got["local://compliance/kyc.md"]["content"] == "Mail [REDACTED_EMAIL] about clients."
    assert got["local://compliance/kyc.md"]["visibility"] == "team" and got["local://compliance/kyc.md"]["category"] == "compliance"
    assert got["local://code/x.py"]["location"] == "Block 1"
    assert mt.ingest_summary(status).first().asDict() == {"ok": 2, "skipped": 0, "failed": 0, "chunks": 2}
    again, status = ingest.ingest_batch(files, rows.select("tenant_id", "file_hash", "source").distinct(), embed)
    assert again.count() == 0 and {r["status"] for r in status.collect()} == {"unchanged"}


# --- reconcile and streams ------------------------------------------------------------------------

def as_files(spark, rows):
    df = spark.createDataFrame(rows, "key string, text string")
    return df.select(F.lit("t").alias("tenant_id"), "key", F.concat(F.lit("s3://kb/"), "key").alias("source"), F.md5("text").alias("file_hash"),
                     F.md5("text").alias("etag"), F.length("text").cast("bigint").alias("size_bytes"), "text")


def listing(files):
    return files.select("tenant_id", F.col("key").alias("s3_key"), "etag", "file_hash", "size_bytes")


def live(t):
    return sorted((r["source"], r["content"]) for r in t.live_chunks().collect())


def test_reconcile_passes_and_replay(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    one = as_files(spark, [("a.md", "first a"), ("b.md", "first b"), ("c.md", "same c")])
    two = as_files(spark, [("a.md", "second a"), ("c.md", "same c"), ("d.md", "new d")])
    assert ingest.reconcile(t, listing(one), one, 1, NOW, embed).first()["new"] == 3
    for _ in range(2):     # the second round is a replay of the same batch
        s = ingest.reconcile(t, listing(two), two, 2, NOW, embed).first().asDict()
        assert s == {"scanned": 3, "new": 1, "changed": 1, "deleted": 1, "unchanged": 1}
        assert live(t) == [("s3://kb/a.md", "second a"), ("s3://kb/c.md", "same c"), ("s3://kb/d.md", "new d")]
    assert ingest.reconcile(t, listing(two), two, 3, NOW, embed).first()["unchanged"] == 3
    assert {r["source"] for r in t.ledger().collect()} == {"s3://kb/a.md", "s3://kb/c.md", "s3://kb/d.md"}


def test_crash_before_manifest_keeps_the_old_state(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    one = as_files(spark, [("a.md", "first a")])
    ingest.reconcile(t, listing(one), one, 1, NOW, embed).collect()
    two = as_files(spark, [("a.md", "second a")])
    t.write("chunks", ingest.index_rows(two, embed), 2)          # and then the job dies
    assert live(t) == [("s3://kb/a.md", "first a")]


def test_totals_come_from_stored_sketches(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    assert t.totals().first().asDict() == {"chunks": 0, "sources": 0}
    one, two = (as_files(spark, [(f"{n}.md", f"text of {n} {b}") for n in names]) for b, names in ((1, range(30)), (2, range(20, 50))))
    ingest.reconcile(t, listing(one), one, 1, NOW, embed).collect()
    for _ in range(2):  # replayed, a batch still counts once
        ingest.reconcile(t, listing(two), two, 2, NOW, embed).collect()
    assert t.totals().first().asDict() == {"chunks": 60, "sources": 50}
    t.compact(3)  # twenty files are gone by now
    assert t.totals().first().asDict() == {"chunks": 30, "sources": 30}
    assert {r["tenant_id"]: r["chunks"] for r in t.totals("tenant_id").collect()} == {one.first()["tenant_id"]: 30}
    scans = [f for f in t.totals("category").inputFiles() if "/chunks/" in f]
    assert not scans


def test_sketched_sources_stay_within_the_stated_error(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in tb.CHUNKS.split(", ") if c.split()[0] not in ("source", "tenant_id", "category", "batch")]
    for batch in range(3):  # neighbouring batches share half of their names
        rows = spark.range(batch * 20_000, batch * 20_000 + 40_000).select(
            F.concat(F.lit("s3://kb/"), "id").alias("source"), F.lit("t").alias("tenant_id"), F.lit("c").alias("category"), *empty)
        t.write("chunks", rows, batch)
    got = t.totals().first()
    assert got["chunks"] == 120_000 and abs(got["sources"] - 80_000) <= 0.03 * 80_000


def test_unread_files_fail_and_are_tried_again(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    files = as_files(spark, [("r.pdf", None), ("i.png", None), ("a.md", "text"), ("b.md", "  ")]).withColumn("file_hash", F.col("key")).withColumn("etag", F.col("key"))
    for batch in (1, 2):
        ingest.reconcile(t, listing(files), files, batch, NOW, embed).collect()
        status = {(r["key"], r["status"], r["chunks"]) for r in t.read("status").filter(F.col("batch") == batch).collect()}
        rest = {1: {("a.md", "ok", 1), ("b.md", "skipped", 0)}, 2: {(None, "unchanged", 2)}}[batch]  # keys without a change are counted, not listed
        assert status == {("r.pdf", "failed", 0), ("i.png", "failed", 0)} | rest
    assert {r["s3_key"] for r in t.manifest().collect()} == {"a.md", "b.md"}
    assert {(r["key"], r["attempts"]) for r in mt.dead_letter(t.attempts(), 2).filter("route = 'dead_letter'").collect()} == {("r.pdf", 2), ("i.png", 2)}


def test_media_become_chunks(spark, tmp_dir):
    said = "array<struct<start:double,end:double,text:string>>"
    shown = "array<struct<page:int,image:int,chars:int,width:int,height:int,confidence:double,ocr:string,description:string>>"
    rows = [("a/r.pdf", ["page one has enough to read", None], None, [(0, 0, 0, 10, 10, 0.0, None, None)]), ("a/t.mp3", None, [(0.0, 5.0, "hello"), (5.0, 9.0, " ")], None),
            ("a/n.md", None, None, None)]
    files = spark.createDataFrame(rows, f"key string, pages array<string>, segments {said}, images {shown}").select(
        F.lit("t").alias("tenant_id"), "key", F.concat(F.lit("s3://kb/"), "key").alias("source"), F.col("key").alias("file_hash"), F.lit(9).alias("size_bytes"),
        F.when(F.col("key") == "a/n.md", "note").alias("text"), "pages", "segments", "images")
    got = {(r["source_type"], r["location"]) for r in ingest.chunk_files(files).collect()}
    assert got == {("document", "Page 1"), ("document", "Section 1"), ("audio", "Timestamp 00:00 - 00:05"), ("image", "Page 1, Image 1")}
    assert ingest.index_rows(files, embed).select("id").distinct().count() == 4


def test_tenants_keep_their_files(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    a = as_files(spark, [("x/a.md", "of tenant a")])
    b = as_files(spark, [("x/a.md", "of tenant b")]).withColumn("tenant_id", F.lit("u"))
    ingest.reconcile(t, listing(a), a, 1, NOW, embed).collect()
    both = a.unionByName(b)
    s = ingest.reconcile(t, listing(both), both, 2, NOW, embed).first().asDict()
    assert (s["new"], s["unchanged"], s["deleted"]) == (1, 1, 0)
    assert sorted((r["tenant_id"], r["content"]) for r in t.live_chunks().collect()) == [("t", "of tenant a"), ("u", "of tenant b")]
    rest, counts = mt.delete_cascade(a.select("tenant_id", "source"), chunks=(t.live_chunks(), "source"))
    assert [r["tenant_id"] for r in rest["chunks"].collect()] == ["u"] and counts.first()["removed"] == 1


def test_new_etag_of_the_same_text_keeps_the_chunks(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    one = as_files(spark, [("a.md", "same")])
    ingest.reconcile(t, listing(one), one, 1, NOW, embed).collect()
    two = one.withColumn("etag", F.lit("other"))
    assert ingest.reconcile(t, listing(two), two, 2, NOW, embed).first()["changed"] == 1
    assert t.read("chunks").count() == 1 and live(t) == [("s3://kb/a.md", "same")]
    assert ingest.reconcile(t, listing(two), two, 3, NOW, embed).first()["unchanged"] == 1


def test_empty_replay_replaces_its_batch(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    one = as_files(spark, [("a.md", "text")])
    ingest.reconcile(t, listing(one), one, 1, NOW, embed).collect()
    none = one.limit(0)
    ingest.reconcile(t, listing(none), none, 1, NOW, embed).collect()
    assert t.live_chunks().count() == 0 and t.read("chunks").count() == 0


def test_only_a_missing_table_reads_as_empty(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    assert t.read("manifest").count() == 0
    write(tmp_dir, "kb/manifest/batch=1/part-0.parquet", "not parquet")
    with pytest.raises(Exception):
        t.read("manifest").collect()


def test_lost_messages_become_dead_letters(spark, tmp_dir):
    inbox, t = tmp_dir + "/inbox", tb.BatchTables(spark, tmp_dir + "/kb")
    write(inbox, "one.json", "\n".join(["{broken", *(json.dumps({"detail": {"bucket": {"name": "kb"}, "object": {"key": k}}}) for k in ("a.md", "gone.md"))]))
    files = as_files(spark, [("a.md", "text")])
    objects.start_ingest(objects.read_object_events(spark, inbox), lambda keys: files.join(keys, "key"), t, tmp_dir + "/ckpt",
                         embed=embed, trigger={"availableNow": True}).awaitTermination()
    assert {(r["reason"], r["body"]) for r in t.read("dead_letters").collect()} == {("unreadable", "{broken"), ("not fetched", '{"bucket":"kb","key":"gone.md"}')}
    assert {(r["key"], r["status"]) for r in t.read("status").collect()} == {("a.md", "ok"), ("gone.md", "failed")}


def test_bad_records_and_buckets_are_told_apart(spark, tmp_dir):
    def record(bucket, key):
        return {"s3": {"bucket": {"name": bucket}, "object": {"key": key} if key else {}}}

    inbox, t = tmp_dir + "/inbox", tb.BatchTables(spark, tmp_dir + "/kb", tenant="t")
    write(inbox, "one.json", json.dumps({"Records": [record("kb", "a.md"), record("kb", None), record("other", "a.md")]}))
    files = as_files(spark, [("a.md", "text")])
    objects.start_ingest(objects.read_object_events(spark, inbox), lambda keys: files.join(keys.filter("bucket = 'kb'"), "key"), t, tmp_dir + "/ckpt",
                         embed=embed, trigger={"availableNow": True}).awaitTermination()
    assert {(r["reason"], r["body"]) for r in t.read("dead_letters").collect()} == {
        ("unreadable", '{"Records":[{"s3":{"bucket":{"name":"kb"},"object":{}}}]}'), ("not fetched", '{"bucket":"other","key":"a.md"}')}
    assert {(r["tenant_id"], r["bucket"], r["key"], r["status"]) for r in t.read("status").collect()} == {("t", None, "a.md", "ok"), ("t", "other", "a.md", "failed")}
    q = retries.start_routing(t.outcomes(), tmp_dir + "/routes", tmp_dir + "/ckpt2", limit=1, trigger={"availableNow": True})
    q.awaitTermination()
    assert [(r["bucket"], r["key"], r["route"]) for r in retries.read_routes(spark, tmp_dir + "/routes").collect()] == [("other", "a.md", "dead_letter")]


def test_retry_state_over_batches_and_its_end(spark, tmp_dir):
    def add(n, *rows):
        df = spark.createDataFrame(rows, "tenant_id string, bucket string, key string, status string, error string, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_dir}/in/batch={n}")

    schema = "tenant_id string, bucket string, key string, status string, error string, ts timestamp"

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*")
        q = retries.start_routing(stream, tmp_dir + "/out", tmp_dir + "/ckpt", limit=3, forget="1 hour", trigger={"availableNow": True})
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) if hasattr(x, "json") else x for x in q.recentProgress) if p["stateOperators"]]
        return kept[-1]

    add(1, ("t", "b", "k", "failed", "1", "2024-01-01 00:00:00"), ("t", "c", "k", "failed", "2", "2024-01-01 00:00:00"), ("u", None, "k", "failed", "3", "2024-01-01 00:01:00"))
    run()
    add(2, ("t", "b", "k", "failed", "4", "2024-01-01 00:20:00"), ("t", "c", "k", "ok", None, "2024-01-01 00:20:00"), ("u", None, "k", "failed", "5", "2024-01-01 03:00:00"))
    run()
    add(3, ("t", "b", "k", "failed", "6", "2024-01-01 00:50:00"), ("t", "c", "k", "failed", "7", "2024-01-01 02:50:00"))
    run()
    add(4, ("z", "z", "z", "ok", None, "2024-01-09 00:00:00"))
    run()
    add(5, ("z", "z", "z", "ok", None, "2024-01-09 01:00:00"))
    assert run() == 0  # timers have dropped all counts
    got = {(r["error"], r["attempts"], r["route"]) for r in retries.read_routes(spark, tmp_dir + "/out").collect()}
    # the third failure of (t, b, k) comes after the watermark has passed it by and is dropped as late
    assert got == {("1", 1, "retry"), ("2", 1, "retry"), ("3", 1, "retry"), ("4", 2, "retry"), ("5", 1, "retry"), ("7", 1, "retry")}
    assert {r["error"] for r in retries.open_retries(retries.read_routes(spark, tmp_dir + "/out")).collect()} == {"4", "5", "7"}


def test_manifest_snapshots_bound_what_a_pass_reads(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")

    def rows(n, deleted=False):
        return spark.range(5).selectExpr("'t' AS tenant_id", f"concat('k', (id + {n}) % 20) AS s3_key", "'s' AS source", f"'h{n}' AS file_hash", "'e' AS etag", "1L AS size_bytes",
                                         f"{str(deleted).lower()} AND id = 0 AS deleted", f"{n}L AS chunk_batch", "timestamp '2024-01-01' AS last_seen_at", "timestamp '2024-01-01' AS last_etag_at")

    want = {}
    for n in range(1, 51):
        t.write("manifest", rows(n, deleted=n % 7 == 0), n)
        for i in range(5):
            want[f"k{(i + n) % 20}"] = None if n % 7 == 0 and i == 0 else f"h{n}"
        if n % tb.SNAPSHOT_EVERY == 0:
            t.snapshot(n)
    now = t.manifest()
    assert {r["s3_key"]: r["file_hash"] for r in now.collect()} == {k: v for k, v in want.items() if v}
    plan = t.manifest()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: [^\n]*batch#\d+L? > 48", plan) and re.search(r"PartitionFilters: [^\n]*upto#\d+L? = 48", plan)
    assert {r["file_hash"] for r in t.manifest(before=3).collect()} == {"h1", "h2"}


def test_compaction_keeps_what_is_live(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    for batch, files in enumerate(([("a.md", "first a"), ("b.md", "b")], [("a.md", "second a"), ("b.md", "b")], [("a.md", "second a"), ("c.md", "c")]), 1):
        files = as_files(spark, files)
        ingest.reconcile(t, listing(files), files, batch, NOW, embed).collect()
    before = live(t)
    for _ in range(2):  # a repetition changes nothing
        t.compact(4)
        assert live(t) == before and t.read("chunks").count() == len(before) and {r["batch"] for r in t.read("chunks").collect()} == {4}
    files = as_files(spark, [("a.md", "third a"), ("c.md", "c")])
    s = ingest.reconcile(t, listing(files), files, 5, NOW, embed).first()
    assert (s["changed"], s["unchanged"]) == (1, 1) and live(t) == [("s3://kb/a.md", "third a"), ("s3://kb/c.md", "c")]


def test_another_header_parser_reaches_the_index(spark, tmp_dir):
    def first_line(text):
        """The first line names who may read."""
        shape = "struct<visibility:string,groups:array<string>,users:array<string>>"
        who = F.from_json(F.to_json(F.struct(F.lit("team").alias("visibility"), F.array(F.split(text, "\n")[0]).alias("users"))), shape)
        return F.struct(who.alias("permissions"), F.substring_index(text, "\n", -1).alias("body"))

    files = as_files(spark, [("a.md", "ann@x.org\nthe text of a")])
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    ingest.reconcile(t, listing(files), files, 1, NOW, embed, front=first_line).collect()
    rows, _ = ingest.ingest_batch(files, spark.createDataFrame([], "tenant_id string, file_hash string, source string"), embed, first_line)
    for r in (t.live_chunks().first(), rows.first()):
        assert (r["content"], r["visibility"], r["users"]) == ("the text of a", "team", ["ann@x.org"])


def test_tables_of_one_tenant(spark, tmp_dir):
    a = as_files(spark, [("x/a.md", "of tenant a")])
    b = a.withColumn("tenant_id", F.lit("u"))
    ingest.reconcile(tb.BatchTables(spark, tmp_dir + "/kb"), listing(a.unionByName(b)), a.unionByName(b), 1, NOW, embed).collect()
    t = tb.BatchTables(spark, tmp_dir + "/kb", tenant="t")
    assert {r["tenant_id"] for r in t.live_chunks().collect()} == {"t"} == {r["tenant_id"] for r in t.manifest().collect()}
    with pytest.raises(Exception, match="another tenant"):
        t.write("chunks", ingest.index_rows(b, embed), 2)


def test_reconcile_runs_on_ticks(spark, tmp_dir):
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    files = as_files(spark, [("a.md", "text")])
    write(tmp_dir + "/ticks", "one.txt", "tick")
    q = objects.start_reconcile(spark.readStream.text(tmp_dir + "/ticks"), lambda: (listing(files), files), t, tmp_dir + "/ckpt", every="1 second", embed=embed)
    try:
        for _ in range(60):
            if q.lastProgress and t.read("status").count():
                break
            q.awaitTermination(1)
        assert live(t) == [("s3://kb/a.md", "text")]
    finally:
        q.stop()


def test_event_forms(spark):
    def s3(key):
        return {"s3": {"bucket": {"name": "kb"}, "object": {"key": key}}}

    bodies = [json.dumps({"Records": [s3("a+b%2Fc.md"), s3("d.md")]}), json.dumps({"detail": {"bucket": {"name": "kb"}, "object": {"key": "e.md"}}}),
              "{broken", json.dumps({"Records": []}), json.dumps({"detail": {}}), json.dumps({"x": 1})]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    good, bad = objects.parse_object_events(df)
    assert sorted((r["n"], r["key"]) for r in good.collect()) == [(0, "a b/c.md"), (0, "d.md"), (1, "e.md")]
    assert sorted(r["n"] for r in bad.collect()) == [2, 3, 4, 5]
    first, _ = objects.parse_object_events(df, first_only=True)
    assert sorted((r["n"], r["key"]) for r in first.collect()) == [(0, "a+b%2Fc.md"), (1, "e.md")]


def test_stream_follows_changes(spark, tmp_dir):
    inbox, t = tmp_dir + "/inbox", tb.BatchTables(spark, tmp_dir + "/kb")
    os.makedirs(inbox)
    state = {"rows": [("a.md", "first a"), ("b.md", "first b")]}

    def fetch(keys):
        return as_files(spark, state["rows"]).join(keys, "key")

    def deliver(name, *keys):
        with open(f"{inbox}/{name}.json", "w") as f:
            f.writelines(json.dumps({"detail": {"bucket": {"name": "kb"}, "object": {"key": k}}}) + "\n" for k in keys)
        objects.start_ingest(objects.read_object_events(spark, inbox), fetch, t, tmp_dir + "/ckpt", embed=embed,
                             trigger={"availableNow": True}).awaitTermination()

    deliver("one", "a.md", "b.md", "a.md")
    assert live(t) == [("s3://kb/a.md", "first a"), ("s3://kb/b.md", "first b")]
    state["rows"][0] = ("a.md", "second a")
    deliver("two", "a.md", "b.md")
    assert live(t) == [("s3://kb/a.md", "second a"), ("s3://kb/b.md", "first b")]
    n = t.read("chunks").count()
    deliver("three", "a.md", "b.md")
    assert t.read("chunks").count() == n and len(live(t)) == 2


def test_redelivery(spark, tmp_dir):
    rows = [("k", "e", "2024-01-01 00:00:00"), ("k", "e", "2024-01-01 00:05:00"), ("k", "f", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "key string, etag string, at string").write.json(tmp_dir + "/in")
    s = spark.readStream.schema("key string, etag string, at timestamp").json(tmp_dir + "/in")
    q = objects.drop_redelivered(s, "at", ["key", "etag"], "1 hour").writeStream.format("memory").queryName("redelivered").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("redelivered").count() == 2


def test_activity_stream_equals_batch(spark, tmp_dir):
    df = spark.range(400).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(4).write.parquet(tmp_dir + "/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(tmp_dir + "/in")
    activity.start_activity(s, tmp_dir + "/out", tmp_dir + "/ckpt", trigger={"availableNow": True}).awaitTermination()
    got = activity.latest_windows(spark.read.parquet(tmp_dir + "/out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, activity.activity_windows(df).collect()))


# --- audit, sinks, tool calls --------------------------------------------------------------------------

def test_audit_leaves_out_empty_fields(spark, tmp_dir):
    df = spark.createDataFrame([("u@x.org", "q", ["b", "a", "b"], True), ("v@x.org", "q", [], None)], "u string, q string, f array<string>, r boolean")
    rows = df.select(*audit.audit_entry(tenant_id=F.lit("t"), user_email=F.col("u"), query=F.col("q"), accessed=F.col("f"), at=F.current_timestamp(), refused=F.col("r")))
    audit.append_audit(rows.coalesce(1), tmp_dir + "/log")
    lines = [json.loads(r["value"]) for r in spark.read.text(tmp_dir + "/log").collect()]
    assert sorted(len(x) for x in lines) == [5, 6] and lines[0]["accessed_files"] == ["a", "b"]
    assert audit.read_audit(spark, tmp_dir + "/log").count() == 2


def test_audit_tail_cuts_before_it_skips(spark):
    lines = spark.createDataFrame([(1, '{"query": "old"}'), (2, '{"query": "one"}'), (3, "{broken"), (4, '{"query": "two"}')], "n int, value string")
    got = [r["entry"]["query"] for r in audit.audit_tail(lines, 3, F.col("n")).orderBy(F.col("n").desc()).collect()]
    assert got == ["two", "one"]


def test_clear_and_replace(spark, tmp_dir):
    tb.replace_table(spark.range(3), tmp_dir + "/a")
    tb.clear_index(spark, tmp_dir + "/a")
    assert spark.read.parquet(tmp_dir + "/a").count() == 0 and spark.read.parquet(tmp_dir + "/a").columns == ["id"]


def test_copy_tenant_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, tenant_id string")
    one, two = (sorted(map(tuple, mt.copy_tenant(df, "a", "b").collect())) for _ in range(2))
    assert one == two and len({i for i, _ in one}) == 4


@pytest.mark.parametrize("blob, want", [
    ("", {}), ('query="a, b", top_k=5', {"query": "a, b", "top_k": "5"}), ("flag=True, none=None, x=1.5.", {"flag": "true", "none": None, "x": "1.5"}),
    ('"source": "a.md", "n": 2', {"source": "a.md", "n": "2"}), ("name=two words, l=[1, 2]", {"name": "two words", "l": "[1, 2]"}), ("no pairs", {})])
def test_arguments(blob, want):
    assert split_arguments(blob) == want


def test_tool_calls(spark):
    texts = ['I use search_documents(query="x (y) z", top_k=3) and list_files().', 'ok [{"name": "read_chunk", "arguments": {"source": "a.md"}}] list_files()',
             '[{"name": "list_files", "arguments": "{\\"category\\": \\"hr\\"}"}]', "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(c["tool"], c["args"]) for c in r[0] or []] for r in df.select(tool_calls(F.col("t"))).collect()]
    assert got[0] == [("search_documents", {"query": "x (y) z", "top_k": "3"}), ("list_files", {})]
    assert got[1] == [("read_chunk", {"source": "a.md"})] and got[3] == [] and got[4] == []


def test_listed_files_of_one_category_are_spread_over_tasks(spark, monkeypatch):
    """Requests x files rows of a single category come from many tasks; requests for all files, and equal ids, get them too."""
    monkeypatch.setattr(tools, "LIST_REQUESTS", 10)
    monkeypatch.setattr(tools, "PART_FILES", 30)
    chunks = spark.range(600).selectExpr(
        "concat('local://f', id % 300) AS source", "IF(id % 300 < 290, 'hr', IF(id % 300 < 295, 'it', NULL)) AS category", "timestamp_seconds(id) AS created_at")
    asked = spark.range(200).selectExpr("IF(id < 20, 0L, id) AS request_id", "CASE WHEN id < 190 THEN 'hr' WHEN id < 195 THEN 'no' WHEN id < 198 THEN 'it' END AS category")
    got = tools.list_files(asked, chunks).withColumn("task", F.spark_partition_id())
    rows = got.groupBy("task").count().collect()
    assert sum(r["count"] for r in rows) == 190 * 290 + 3 * 5 + 2 * 300
    assert max(r["count"] for r in rows) < 190 * 290 / 4
    per = {r["request_id"]: (r["count"], r["files"]) for r in got.groupBy("request_id").agg(F.count("*").alias("count"), F.countDistinct("source").alias("files")).collect()}
    assert per[0] == (20 * 290, 290) and per[20] == (290, 290) and per[195] == (5, 5) and per[198] == per[199] == (300, 300) and 190 not in per
    assert got.filter("request_id = 199").agg(F.min("chunks"), F.max("chunks")).first() == (2, 2)
    assert tools.list_files(asked.limit(0), chunks).count() == 0


def test_embedding_seams(spark):
    df = spark.createDataFrame([("Hello world",), ("...",)], "t string")
    vectors = [r["embedding"] for r in embed(df, "t").collect()]
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-4 and not any(vectors[1])
    got = embed_model(df, "t", lambda: (lambda texts: [[float(len(x)), 1 / 3] for x in texts])).collect()
    assert got[0]["embedding"] == pytest.approx([len("search_document: Hello world"), 0.333333])


def test_lookup_stages(spark):
    c = spark.createDataFrame([(1, "local://hr/Leave-Policy.md", "Section 1", "one", "hr"), (2, "local://hr/Leave-Policy.md", "Section 2", "two", "hr"),
                               (3, "local://it/q2-board-minutes.md", "Section 1", "three", "it")],
                              "id bigint, source string, location string, content string, category string")
    r = spark.createDataFrame([(1, "local://hr/Leave-Policy.md", "Section 2"), (2, "lost/leave-policy.md", "x"), (3, "none.md", "x"), (4, "", "x")],
                              "request_id bigint, source string, location string")
    got = {x["request_id"]: (x["stage"], x["content"]) for x in catalog.read_chunk(r, c).collect()}
    assert got == {1: (1, "two"), 2: (2, "one"), 3: (None, None), 4: (None, None)}
    d = spark.createDataFrame([(1, "local://it/q2-board-minutes.md"), (2, "x/leave-policy"), (3, "board-minutes-q2-v1.md"), (4, "zzz")], "request_id bigint, source string")
    got = {x["request_id"]: (x["stage"], x["source"]) for x in catalog.resolve_document(d, c).collect()}
    assert got == {1: (1, "local://it/q2-board-minutes.md"), 2: (2, "local://hr/Leave-Policy.md"), 3: (3, "local://it/q2-board-minutes.md"), 4: (None, None)}


def test_best_by_tokens_meets_common_tokens_by_sets(spark, monkeypatch):
    """Rare and common tokens give what all pairs give, and no request meets every file."""
    names = [(i, sorted({f"w{i % 3}", f"v{i % 5}", f"n{i}"})) for i in range(60)]
    asks = [(1, ["w1", "v2", "n3"]), (2, ["w2"]), (3, ["n7", "zz"]), (4, ["zz"]), (5, ["v4", "w0", "q"]), (6, [])]
    f = spark.createDataFrame(names, "id bigint, tokens array<string>")
    r = spark.createDataFrame(asks, "request_id bigint, tokens array<string>")
    want = {}
    for q, tokens in asks:
        score, i = max((len(set(tokens) & set(t)), -i) for i, t in names)
        if score:
            want[q] = -i
    met, plain = [], catalog.scoring.best_k
    monkeypatch.setattr(catalog.scoring, "best_k", lambda kind, q, c, k: met.append((q.count(), c.count())) or plain(kind, q, c, k))
    for common in (0, 1, 15, 100):
        assert {x["request_id"]: x["id"] for x in catalog.best_by_tokens(r, f, common).collect()} == want
    assert met[1] == (3, 15)  # sets of the eight common tokens, not five requests and sixty files


def test_replaced_batches_are_not_read_again(spark, tmp_dir):
    """Chunks of a batch without a live source stay unread; of others, only replaced sources are left out."""
    t = tb.BatchTables(spark, tmp_dir + "/kb")
    for batch, (a, b) in enumerate((("one", "two"), ("one", "three"), ("four", "three")), 1):
        files = as_files(spark, [("a.md", a), ("b.md", b)])
        ingest.reconcile(t, listing(files), files, batch, NOW, embed).collect()
        assert live(t) == [("s3://kb/a.md", a), ("s3://kb/b.md", b)]
    assert re.search(r"batch#\d+L? IN \((2,3|3,2)\)", t.live_chunks()._jdf.queryExecution().optimizedPlan().toString())


def test_the_shorter_list_of_keys_selects_files(spark):
    files = spark.range(10).selectExpr("'t' AS tenant_id", "CASE WHEN id < 8 THEN concat('k', id) END AS key", "id").cache()
    for n, kind in ((6, "LeftAnti"), (2, "LeftSemi"), (0, "LeftSemi"), (8, "LeftAnti")):
        got = ingest.only_keys(files, files.filter(f"id < {n}").select("tenant_id", "key"))
        assert sorted(r["id"] for r in got.collect()) == list(range(n))
        assert kind in got._jdf.queryExecution().analyzed().toString()
