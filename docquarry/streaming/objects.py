"""Object-created events: parse, de-duplicate, ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions.seams import embed_hashed
from docquarry.operators.chunking import front_matter
from docquarry.plans.ingest import apply_changes
from docquarry.operators.maintenance import manifest_diff
from docquarry.session import persist_table
from docquarry.sources.tables import BatchTables

_OBJECT = "struct<bucket:struct<name:string>,object:struct<key:string,eTag:string>>"
_EVENT = f"struct<Records:array<struct<s3:{_OBJECT}>>,detail:{_OBJECT}>"


def object_events(body: Column, first_only: bool = False) -> Column:
    """``array<struct<bucket,key,etag,record>>`` of a message in either envelope, a struct for each record.

    ``record`` is null for a record that names an object; otherwise it is that record alone, as a message.
    ``first_only`` looks at the first record alone and keeps keys as they are; otherwise all records count and keys
    are URL-decoded. A message that cannot be read, or has no record, gives nothing.
    """
    event = F.from_json(body, _EVENT)
    records = F.when(event["Records"].isNotNull(), F.transform(event["Records"], lambda r: r["s3"])).otherwise(
        F.filter(F.array(event["detail"]), lambda d: d.isNotNull()))
    if first_only:
        records = F.slice(records, 1, 1)

    def flat(r: Column) -> Column:
        bucket, raw = r["bucket"]["name"], r["object"]["key"]
        key = raw if first_only else F.try_url_decode(raw)
        named = F.coalesce((bucket != "") & (key != ""), F.lit(False))
        alone = F.to_json(F.struct(F.array(F.struct(r.alias("s3"))).alias("Records")))
        return F.struct(bucket.alias("bucket"), key.alias("key"), r["object"]["eTag"].alias("etag"), F.when(~named, alone).alias("record"))

    return F.coalesce(F.transform(records, flat), F.array().cast("array<struct<bucket:string,key:string,etag:string,record:string>>"))


def parse_object_events(messages: DataFrame, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Readable events, and messages to set aside; of a message with good records only its bad ones are, a message each."""
    parsed = messages.withColumn("_e", object_events(F.col("body"), first_only))
    parsed = parsed.withColumn("_good", F.filter("_e", lambda e: e["record"].isNull()))
    others = [c for c in messages.columns if c != "body"]
    good = parsed.select(*others, F.explode("_good").alias("e")).select(*others, "e.bucket", "e.key", "e.etag")
    bad = F.when(F.size("_good") == 0, F.array("body")).otherwise(F.transform(F.filter("_e", lambda e: e["record"].isNotNull()), lambda e: e["record"]))
    return good, parsed.select(*others, F.explode(bad).alias("body")).select(*messages.columns)


def read_object_events(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Messages as a stream of text files, one JSON message per line."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder).select(
        F.col("value").alias("body"))


def drop_redelivered(events: DataFrame, time: str, keys: list[str], within: str) -> DataFrame:
    """Drop repeated deliveries; state is kept for ``within`` only."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def start_ingest(
    messages: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    tables: BatchTables,
    checkpoint: str,
    *,
    embed: Callable[[DataFrame, str], DataFrame] = embed_hashed,
    front: Callable[[Column], Column] = front_matter,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the index in step with a stream of messages.

    ``fetch`` turns distinct ``(bucket, key)`` rows into files (``tenant_id, bucket, key,
    source, file_hash, etag, size_bytes, text``). A batch is diffed against the
    manifest of earlier batches only, and written under its own number: repeated
    deliveries find nothing to do, a replayed batch replaces itself. Messages that
    cannot be read and objects that ``fetch`` does not return go to the dead
    letters of the batch; the latter also to the status log. ``retries`` reads that
    log as a stream and tells what to try again; ``maintenance.dead_letter`` folds it in one go.
    """

    def run(batch_df: DataFrame, epoch: int) -> None:
        now = F.current_timestamp()
        events, unread = parse_object_events(batch_df.select("body"))
        asked = persist_table(events.select("bucket", "key").distinct(), "asked")
        # files are read once, and all steps of the batch see the same state of them
        files = persist_table(fetch(asked), "files")
        lost = asked.join(files.select("bucket", "key"), ["bucket", "key"], "left_anti")
        dead = unread.select("body", F.lit("unreadable").alias("reason")).unionByName(
            lost.select(F.to_json(F.struct("bucket", "key")).alias("body"), F.lit("not fetched").alias("reason")))
        tables.write("dead_letters", dead.withColumn("ts", now), epoch)
        keys = files.select("tenant_id", F.col("key").alias("s3_key"), "etag", "file_hash", "size_bytes")
        known = tables.manifest(before=epoch, keys=keys)
        diff = persist_table(manifest_diff(keys, known), "diff")
        failures = lost.select(F.lit(tables.tenant).cast("string").alias("tenant_id"), "bucket", "key", F.lit("not fetched").alias("error"))
        apply_changes(tables, diff, files, epoch, now, embed, failures, front)

    return (
        messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def start_reconcile(
    ticks: DataFrame,
    list_objects: Callable[[], tuple[DataFrame, DataFrame]],
    tables: BatchTables,
    checkpoint: str,
    every: str = "10 minutes",
    embed: Callable[[DataFrame, str], DataFrame] = embed_hashed,
    front: Callable[[Column], Column] = front_matter,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run a reconcile pass at every trigger of a tick stream (such as the rate source)."""
    from docquarry.plans.ingest import reconcile

    def run(_: DataFrame, epoch: int) -> None:
        listing, files = list_objects()
        reconcile(tables, listing, files, epoch, F.current_timestamp(), embed, front).collect()

    return (ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": every})).start())
