"""Snapshots of ledger, manifest and index: diffs, upserts, deletes.

Tables are immutable snapshots. Every operator returns the next snapshot (or
the actions that lead to it) as one join of the old one with the changes;
publishing it is the caller's single atomic step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions.text import is_allowed, object_hash


def object_listing(objects: DataFrame) -> DataFrame:
    """Supported objects with their hash: ``s3_key, etag, file_hash, size_bytes``."""
    return objects.filter(is_allowed(F.col("s3_key"))).select(
        "s3_key", "etag", object_hash(F.col("etag"), F.col("content")).alias("file_hash"), "size_bytes")


def _keys(one: DataFrame, two: DataFrame) -> list[str]:
    """What names a file: its key within its tenant, where both sides know tenants."""
    return ["tenant_id", "s3_key"] if {"tenant_id"} <= set(one.columns) & set(two.columns) else ["s3_key"]


def manifest_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every key (of a tenant) of either side with its change: new, changed, deleted or unchanged.

    A key whose listing failed (``listing_error``) is kept as it was: it is
    ``unknown``, never ``deleted``.
    """
    has_error = "listing_error" in listing.columns
    keys = _keys(listing, manifest)
    now = listing.select(
        *keys, F.col("etag").alias("n_etag"), F.col("file_hash").alias("n_hash"), F.col("size_bytes").alias("n_size"),
        (F.col("listing_error") if has_error else F.lit(False)).alias("failed"), F.lit(True).alias("listed"))
    old = manifest.select(*keys, F.col("etag").alias("o_etag"), F.col("file_hash").alias("o_hash"), F.lit(True).alias("known"))
    change = (
        F.when(F.coalesce("failed", F.lit(False)), "unknown")
        .when(F.col("known").isNull(), "new")
        .when(F.col("listed").isNull(), "deleted")
        .when(~F.col("n_etag").eqNullSafe(F.col("o_etag")) | ~F.col("n_hash").eqNullSafe(F.col("o_hash")), "changed")
        .otherwise("unchanged"))
    return now.join(old, keys, "full_outer").select(
        *keys, change.alias("change"), F.col("n_etag").alias("etag"), F.col("n_hash").alias("file_hash"),
        F.col("n_size").alias("size_bytes"))


def sync_summary(diff: DataFrame) -> DataFrame:
    """Keys per kind of change. The keys themselves stay rows of the diff."""
    scanned = F.sum(F.when(~F.col("change").isin("deleted"), 1).otherwise(0))
    return diff.agg(
        scanned.alias("scanned"),
        *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "deleted", "unchanged")])


def manifest_upsert(manifest: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """The manifest after a pass; ``last_etag_at`` moves only with the etag."""
    keys = _keys(manifest, listing)
    new = listing.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("etag", "file_hash", "size_bytes")], F.lit(True).alias("seen"))
    both = manifest.withColumn("known", F.lit(True)).join(new, keys, "full_outer")

    def pick(c: str) -> Column:
        return F.when(F.col("seen"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    etag_moved = F.col("known").isNull() | ~F.col("etag").eqNullSafe(F.col("n_etag"))
    return both.select(
        *keys, pick("etag"), pick("file_hash"), pick("size_bytes"),
        F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("seen") & etag_moved, now).otherwise(F.col("last_etag_at")).alias("last_etag_at"))


_LEDGER_KEY = ["tenant_id", "file_hash"]


def ledger_actions(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch files with ``action``: insert, update (known hash, other source) or skip.

    Of several files with the same hash in one batch the first by source is the
    one that decides, so the result does not depend on arrival order.
    """
    one = batch.groupBy(*_LEDGER_KEY).agg(F.min_by(F.struct("source", "chunks"), "source").alias("b"))
    old = ledger.select(*_LEDGER_KEY, F.col("source").alias("known_source"))
    return one.select(*_LEDGER_KEY, "b.source", "b.chunks").join(old, _LEDGER_KEY, "left").withColumn(
        "action", F.when(F.col("known_source").isNull(), "insert")
        .when(F.col("known_source") == F.col("source"), "skip").otherwise("update"))


def ledger_upsert(ledger: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The ledger after a batch: new hashes added, moved hashes rewritten, others kept."""
    acts = ledger_actions(ledger, batch).filter(F.col("action") != "skip").select(
        *_LEDGER_KEY, F.col("source").alias("n_source"), F.col("chunks").alias("n_chunks"))
    both = ledger.join(acts, _LEDGER_KEY, "full_outer")
    hit = F.col("n_source").isNotNull()
    return both.select(
        *_LEDGER_KEY,
        F.when(hit, F.col("n_source")).otherwise(F.col("source")).alias("source"),
        F.when(hit, F.col("n_chunks")).otherwise(F.col("chunks")).alias("chunks"),
        F.when(hit, now).otherwise(F.col("ingested_at")).alias("ingested_at"))


def ledger_new_files(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Files to ingest: hash unknown, or known under another source."""
    return batch.join(ledger.select("tenant_id", "file_hash", "source"), ["tenant_id", "file_hash", "source"], "left_anti")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(filename, hash)`` against known hashes; unknown files count as changed."""
    k = known.select("filename", F.col("hash").alias("known_hash"))
    return files.join(k, "filename", "left").withColumn(
        "changed", F.coalesce(F.col("hash") != F.col("known_hash"), F.lit(True)))


def delete_cascade(sources: DataFrame, **tables: tuple[DataFrame, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove sources from several tables; of a tenant's sources, where ``sources`` names tenants.

    ``tables`` maps a name to ``(table, source column)``. Returns the remaining
    tables and the true number of rows removed from each.
    """
    by_tenant = "tenant_id" in sources.columns
    gone = sources.select(F.col("source").alias("_gone"), *([F.col("tenant_id").alias("_tenant")] if by_tenant else [])).distinct()
    rest, counts = {}, None
    for name, (df, col) in tables.items():
        on = F.col(col) == F.col("_gone")
        if by_tenant:
            on &= F.col("tenant_id") == F.col("_tenant")
        rest[name] = df.join(gone, on, "left_anti")
        n = df.select(col, *(["tenant_id"] if by_tenant else [])).join(gone, on, "left_semi").agg(F.count("*").alias("removed")).select(
            F.lit(name).alias("table"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return rest, counts


def new_chunks_only(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks not yet indexed, one per (source, content).

    Texts are compared by digest. Copies fold to their first row before anything
    is joined, so a text that fills a third of the batch is one key like others.
    """
    digest = F.sha2("content", 256).alias("_d")
    firsts = batch.select("source", digest, "id").groupBy("source", "_d").agg(F.min("id").alias("id"))
    fresh = firsts.join(index.select("source", digest).distinct(), ["source", "_d"], "left_anti")
    return batch.join(fresh.select("id"), "id", "left_semi")


def dead_letter(attempts: DataFrame, limit: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Failed deliveries folded per key (of a tenant and bucket, where the log knows them): what to retry and what to set aside."""
    state = attempts.groupBy(*[c for c in ("tenant_id", "bucket") if c in attempts.columns], "key").agg(
        F.count_if(F.col("status") == "failed").alias("attempts"),
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"),
        F.max_by("error", F.struct("ts", "event_id")).alias("last_error"))
    return state.filter(F.col("last_status") == "failed").withColumn(
        "route", F.when(F.col("attempts") >= limit, "dead_letter").otherwise("retry"))


def provision_tenants(registry: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Add tenants that are missing."""
    fresh = wanted.select("tenant_id", "name").dropDuplicates(["tenant_id"]).join(
        registry.select("tenant_id"), "tenant_id", "left_anti").withColumn("created_at", now)
    return registry.unionByName(fresh)


def copy_tenant(chunks: DataFrame, source: str, target: str) -> DataFrame:
    """The index after copying a tenant's chunks over another's, with fresh ids.

    New ids follow from (old id, target), so a repeated task writes the same rows.
    """
    kept = chunks.filter(F.col("tenant_id") != target)
    copied = chunks.filter(F.col("tenant_id") == source).withColumn("tenant_id", F.lit(target)).withColumn(
        "id", F.xxhash64(F.lit(target), "id"))
    return kept.unionByName(copied)


def ingest_summary(status: DataFrame) -> DataFrame:
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")],
                      F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
