"""From files to index rows: batch ingestion and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.seams import embed_hashed
from docquarry.functions.vectors import is_usable
from docquarry.operators import chunking
from docquarry.operators.maintenance import ledger_new_files, manifest_diff, sync_summary
from docquarry.session import persist_table
from docquarry.sources.tables import SNAPSHOT_EVERY, BatchTables


_PERMISSIONS = "struct<visibility:string,groups:array<string>,users:array<string>>"
_BASE = ["tenant_id", "key", "source", "file_hash"]
_CHUNK = [*_BASE, "source_type", "location", "content", "permissions", "place"]


def has_payload(files: DataFrame) -> Column:
    """Whether a reader gave anything for a file: text, pages, images or transcript segments."""
    found = [F.col(c).isNotNull() for c in ("text", "pages", "images", "segments") if c in files.columns]
    return F.coalesce(*[F.when(f, F.lit(True)) for f in found], F.lit(False))


def _text_chunks(files: DataFrame, front: Callable[[Column], Column]) -> DataFrame:
    """Code in blocks, documents in sections; Markdown headers become permissions."""
    kind, ext = tx.handler_of(F.col("key")), tx.extension_of(F.col("key"))
    opened = files.select(
        *_BASE, kind.alias("_kind"),
        F.when(ext == ".md", front(F.col("text"))).otherwise(F.struct(
            F.lit(None).cast(_PERMISSIONS).alias("permissions"), F.col("text").alias("body"))).alias("_f"))
    routed = opened.select(
        *_BASE, "_kind", "_f.permissions", F.when(F.col("_kind") == "document", F.col("_f.body")).alias("_doc"),
        F.when(F.col("_kind") == "code", F.col("_f.body")).alias("_code"))
    cut = chunking.with_code_pieces(chunking.with_text_pieces(routed, "_doc", "_sections"), "_code", "_blocks")
    rows = tx.unroll(cut, F.coalesce("_sections", "_blocks"), "_i", "content", [*_BASE, "_kind", "permissions"])
    label = F.when(F.col("_kind") == "code", "Block ").otherwise("Section ")
    return rows.select(*_BASE, F.col("_kind").alias("source_type"), F.concat(label, (F.col("_i") + 1).cast("string")).alias("location"),
                       "content", "permissions", F.lit(0).alias("place"))


def _page_chunks(files: DataFrame) -> DataFrame:
    """Pages of paged files; a page that is only a scan gives nothing here."""
    paged = files.filter(tx.handler_of(F.col("key")) == "paged").select(*_BASE, "size_bytes", F.posexplode("pages").alias("_page", "_text"))
    read = paged.filter(~tx.scanned_page(F.coalesce("_text", F.lit("")), F.col("size_bytes"))).drop("size_bytes")
    cut = chunking.with_text_pieces(read, "_text", "_pieces")
    rows = tx.unroll(cut, F.col("_pieces"), "place", "content", [*_BASE, "_page"])
    return rows.select(*_BASE, F.lit("document").alias("source_type"), F.concat(F.lit("Page "), (F.col("_page") + 1).cast("string")).alias("location"),
                       "content", F.lit(None).cast(_PERMISSIONS).alias("permissions"), F.col("place").cast("int").alias("place"))


def _image_chunks(files: DataFrame) -> DataFrame:
    """Texts of images, stand-alone or inside paged files."""
    shown = files.filter(tx.handler_of(F.col("key")).isin("image", "paged")).select(*_BASE, F.explode("images").alias("_image")).select(*_BASE, "_image.*")
    done = chunking.image_chunks(shown, keep=("tenant_id", "key", "file_hash"))
    return done.select(*_BASE, F.lit("image").alias("source_type"), "location", "content", F.lit(None).cast(_PERMISSIONS).alias("permissions"), F.lit(0).alias("place"))


def _transcript_chunks(files: DataFrame) -> DataFrame:
    """Segments of spoken files."""
    kind = tx.handler_of(F.col("key"))
    said = files.filter(kind.isin("video", "audio")).select(*_BASE, kind.alias("source_type"), F.posexplode("segments").alias("place", "_said")).select(
        *_BASE, "source_type", "place", "_said.*")
    done = chunking.transcript_chunks(said, keep=("tenant_id", "key", "file_hash", "source_type", "place"))
    return done.select(*_BASE, "source_type", "location", "content", F.lit(None).cast(_PERMISSIONS).alias("permissions"), "place")


def chunk_files(files: DataFrame, front: Callable[[Column], Column] = chunking.front_matter) -> DataFrame:
    """Files (``tenant_id, key, source, file_hash, text``) to scrubbed chunks.

    What a reader found in other kinds of files comes in further columns, each
    of which may be missing: ``pages`` (array of texts), ``images`` (array of
    struct ``page, image, chars, width, height, confidence, ocr, description``),
    ``segments`` (array of struct ``start, end, text``). ``front`` splits the
    header from a Markdown text; a full YAML parser can take its place.
    """
    rows = _text_chunks(files, front)
    for column, cut in (("pages", _page_chunks), ("images", _image_chunks), ("segments", _transcript_chunks)):
        if column in files.columns:
            rows = rows.unionByName(cut(files).select(*_CHUNK))
    return rows.select(
        "tenant_id", "key", "source", "source_type", "location", tx.scrub(F.col("content")).alias("content"), "file_hash",
        "permissions.visibility", "permissions.groups", "permissions.users", tx.category_of(F.col("key")).alias("category"), "place")


def index_rows(files: DataFrame, embed: Callable[[DataFrame, str], DataFrame] = embed_hashed,
               front: Callable[[Column], Column] = chunking.front_matter) -> DataFrame:
    """Chunks with vectors and ids; chunks without a usable vector are dropped.

    An id is 128 bits of a digest of tenant, source, hash and place, so a
    repeated task gives the same rows and tenants never share one.
    """
    chunks = embed(chunk_files(files, front), "content")
    others = [c for c in chunks.columns if c not in ("embedding", "place")]
    # passing the vector through a generator keeps the filter from being moved below
    # the embedding step, which would then run twice
    once = chunks.select(*others, "place", F.explode_outer(F.array("embedding")).alias("embedding"))
    name = F.sha2(F.to_json(F.struct("tenant_id", "source", "file_hash", "location", "place")), 256)
    return once.filter(is_usable(F.col("embedding"))).withColumn("id", F.substring(name, 1, 32)).drop("place")


def ingest_batch(files: DataFrame, ledger: DataFrame, embed: Callable[[DataFrame, str], DataFrame] = embed_hashed,
                 front: Callable[[Column], Column] = chunking.front_matter) -> tuple[DataFrame, DataFrame]:
    """Index rows of files the ledger does not know under this source, and a status per file.

    Counts are of rows inserted. Known files are left out before anything is
    cut or embedded.
    """
    rejected = ~tx.is_allowed(F.col("key"))
    fresh = ledger_new_files(ledger, files.filter(~rejected))
    rows = index_rows(fresh, embed, front)
    by = ["tenant_id", "source"]
    n = rows.groupBy(*by).agg(F.count("*").alias("chunks"))
    new = fresh.select(*by, has_payload(fresh).alias("_read")).join(n, by, "left").select(
        "source", F.when(F.col("chunks") > 0, "ok").when(F.col("_read"), "skipped").otherwise("failed").alias("status"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"))
    known = files.filter(~rejected).join(fresh.select(*by), by, "left_anti").select(
        "source", F.lit("unchanged").alias("status"), F.lit(0).cast("bigint").alias("chunks"))
    bad = files.filter(rejected).select("source", F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("chunks"))
    return rows, new.unionByName(known).unionByName(bad)


def only_keys(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files whose ``(tenant_id, key)`` is in ``wanted``, a stored table.

    A pass mostly takes nearly all files or few of them. The shorter of both lists, of the keys to take or of those to
    leave out, decides, so that texts are seldom shuffled to a list of all files.
    """
    by = ["tenant_id", "key"]
    named = files.filter(F.col("tenant_id").isNotNull() & F.col("key").isNotNull())
    others = persist_table(named.select(*by).distinct().join(wanted, by, "left_anti"), "left-out")
    return named.join(others, by, "left_anti") if others.count() < wanted.count() else files.join(wanted, by, "left_semi")


def apply_changes(tables: BatchTables, diff: DataFrame, files: DataFrame, batch: int, now: Column,
                  embed: Callable[[DataFrame, str], DataFrame] = embed_hashed, failures: DataFrame | None = None,
                  front: Callable[[Column], Column] = chunking.front_matter) -> DataFrame:
    """Write one batch for a diff: chunks of new and changed files, manifest rows, status rows.

    ``files``: what ``chunk_files`` takes. A changed key whose text is the one
    already indexed under its source keeps its chunks. A file of which nothing
    could be read is ``failed``: it gets no manifest row, so the next pass tries
    it again, and an earlier text stays live. ``failures``: further status rows
    (``tenant_id, bucket, key, error``). Chunks go first, the manifest last; until its
    rows are there the old state stays the live one, so a crash in between loses
    nothing and a replay replaces the same batch.
    """
    by = ["tenant_id", "key"]
    todo = diff.filter(F.col("change").isin("new", "changed")).select(
        "tenant_id", F.col("s3_key").alias("key"), "etag", "size_bytes")
    known = tables.manifest(before=batch, keys=diff.filter(F.col("change").isin("new", "changed", "deleted")))
    before = known.withColumnRenamed("s3_key", "key").select(*by, F.col("source").alias("old_source"), F.col("file_hash").alias("old_hash"), F.col("etag").alias("old_etag"),
                        F.col("chunk_batch").alias("old_batch"), F.col("last_etag_at").alias("old_etag_at"))
    same = F.col("file_hash").eqNullSafe(F.col("old_hash")) & F.col("source").eqNullSafe(F.col("old_source"))
    plan = persist_table(
        files.select(*by, "source", "file_hash", has_payload(files).alias("readable")).join(todo, by).join(before, by, "left")
        .withColumn("same", F.coalesce(same, F.lit(False))), "todo")
    rows = index_rows(only_keys(files.filter(tx.is_allowed(F.col("key"))), plan.filter("readable AND NOT same").select(*by)), embed, front)
    tables.write("chunks", rows, batch)
    n = tables.read("chunks").filter(F.col("batch") == batch).groupBy("tenant_id", "source").agg(F.count("*").alias("chunks"))
    done = persist_table(plan.join(n, ["tenant_id", "source"], "left"), "done")
    etag_moved = ~F.col("etag").eqNullSafe(F.col("old_etag")) | F.col("old_batch").isNull()
    kept = done.filter("same OR readable").select(
        "tenant_id", F.col("key").alias("s3_key"), "source", "file_hash", "etag", "size_bytes", F.lit(False).alias("deleted"),
        F.when(F.col("same"), F.col("old_batch")).otherwise(F.lit(batch)).cast("bigint").alias("chunk_batch"), now.alias("last_seen_at"),
        F.when(etag_moved, now).otherwise(F.col("old_etag_at")).alias("last_etag_at"))
    left = diff.filter(F.col("change") == "deleted").select("tenant_id", "s3_key")
    gone = known.join(left, ["tenant_id", "s3_key"], "left_semi").select(
        "tenant_id", "s3_key", "source", "file_hash", "etag", "size_bytes", F.lit(True).alias("deleted"), "chunk_batch", "last_seen_at", "last_etag_at")

    def line(df: DataFrame, status: Column, chunks: Column, error: Column) -> DataFrame:
        bucket = F.col("bucket") if "bucket" in df.columns else F.lit(None).cast("string")
        return df.select("tenant_id", bucket.alias("bucket"), "key", status.alias("status"), chunks.cast("bigint").alias("chunks"), error.cast("string").alias("error"), now.alias("ts"))

    none, zero = F.lit(None), F.lit(0)
    unread = F.when(tx.is_allowed(F.col("key")), "failed").otherwise("skipped")
    status = line(done, F.when(F.col("same"), "unchanged").when(~F.col("readable"), unread).when(F.col("chunks") > 0, "ok").otherwise("skipped"),
                  F.coalesce("chunks", zero), F.when(~F.col("readable") & ~F.col("same"), "nothing could be read"))
    status = status.unionByName(line(gone.withColumnRenamed("s3_key", "key"), F.lit("deleted"), zero, none))
    # keys without a change make a row for each tenant, with their number, not a row each
    idle = diff.filter(F.col("change") == "unchanged").groupBy("tenant_id").agg(F.count("*").alias("n")).withColumn("key", none.cast("string"))
    status = status.unionByName(line(idle, F.lit("unchanged"), F.col("n"), none))
    if failures is not None:
        status = status.unionByName(line(failures, F.lit("failed"), zero, F.col("error")))
    tables.write("status", status, batch)
    tables.write("manifest", kept.unionByName(gone), batch)
    if batch % SNAPSHOT_EVERY == 0:
        tables.snapshot(batch)
    return status


def reconcile(tables: BatchTables, listing: DataFrame, files: DataFrame, batch: int, now: Column,
              embed: Callable[[DataFrame, str], DataFrame] = embed_hashed, front: Callable[[Column], Column] = chunking.front_matter) -> DataFrame:
    """One pass: diff the listing (``tenant_id, s3_key, etag, file_hash, size_bytes``) against the manifest, apply it, return the summary row."""
    known = tables.manifest(before=batch).select("tenant_id", "s3_key", "etag", "file_hash")
    diff = persist_table(manifest_diff(listing, known), "diff")
    apply_changes(tables, diff, files, batch, now, embed, front=front)
    return sync_summary(diff)
