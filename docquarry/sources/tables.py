"""Index tables as folders of batches, and whole-table sinks.

A batch is written once under its number; writing it again (a replayed stream
batch, a retried job) replaces the same folder. Tenants are part of every key.
Nothing is rewritten when files change: the manifest's newest row per key says
which batch of a source counts, and deletes are manifest rows too.

So that a pass does not fold all history, every ``SNAPSHOT_EVERY`` batches the
folded manifest is stored as a snapshot; later reads take the newest snapshot
and the batches after it. ``compact`` brings the live chunks together in one
batch and empties the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.catalog import assert_tenant, tenant_scope
from docquarry.session import persist_table

SNAPSHOT_EVERY = 16
CHUNKS = (
    "id string, source string, source_type string, location string, content string, "
    "embedding array<float>, file_hash string, visibility string, groups array<string>, users array<string>, "
    "batch bigint, tenant_id string, category string"
)
MANIFEST = (
    "tenant_id string, s3_key string, source string, file_hash string, etag string, size_bytes bigint, deleted boolean, "
    "chunk_batch bigint, last_seen_at timestamp, last_etag_at timestamp, batch bigint"
)
STATUS = "tenant_id string, bucket string, key string, status string, chunks bigint, error string, ts timestamp, batch bigint"
TOTALS = "tenant_id string, category string, chunks bigint, sources binary, batch bigint"
DEAD_LETTERS = "body string, reason string, ts timestamp, batch bigint"
SCHEMAS = {"chunks": CHUNKS, "manifest": MANIFEST, "status": STATUS, "dead_letters": DEAD_LETTERS, "totals": TOTALS}
SKETCH_BITS = 14  # 2 ** 14 registers: a standard error below 1 %
KEY = ["tenant_id", "s3_key"]


@dataclass(frozen=True)
class BatchTables:
    """``chunks``, ``manifest``, ``status`` and ``dead_letters`` below one root folder.

    With ``tenant``, rows of another tenant can be neither written nor read.
    """

    spark: SparkSession
    root: str
    tenant: str | None = None

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        """Write one batch of a table; an earlier try of the batch is replaced, also by no rows at all."""
        spread = {"chunks": ["tenant_id", "category"]}.get(name, [])
        columns = [c.split()[0] for c in _split_schema(SCHEMAS[name]) if c.split()[0] != "batch"]
        # rebalancing by the folder columns makes few, evenly sized files and splits crowded folders
        df = assert_tenant(df, self.tenant) if self.tenant is not None and "tenant_id" in columns else df
        rows = df.select(*columns).hint("rebalance", *spread) if spread else df.select(*columns)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(*spread).parquet(f"{self.root}/{name}/batch={batch}"))

        if name == "chunks":
            self._sum_up(batch)

    def _sum_up(self, batch: int) -> None:
        """Totals of the batch just written: chunk counts, and its source names as a sketch that can be merged.

        Reads two folder columns and ``source`` of that batch; runs again with the batch, so it never counts one twice.
        """
        own = self.read("chunks").filter(F.col("batch") == batch)
        totals = own.groupBy("tenant_id", "category").agg(
            F.count("*").alias("chunks"), F.hll_sketch_agg("source", SKETCH_BITS).alias("sources"))
        self.write("totals", totals.coalesce(1), batch)

    def totals(self, *by: str) -> DataFrame:
        """``by…, chunks, sources`` of all stored batches from their totals; no chunk is read.

        ``by`` may name ``tenant_id`` and ``category``. Chunks are exact, sources estimated (standard error below 1 %).
        What a later batch replaced counts until ``compact``, which makes stored and live chunks the same.
        """
        merged = self.read("totals").groupBy(*by).agg(
            F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.hll_union_agg("sources").alias("_s"))
        return merged.select(*by, "chunks", F.coalesce(F.hll_sketch_estimate("_s"), F.lit(0)).alias("sources"))

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """All batches of a table, or those below ``before``; a table that was never written is empty."""
        df = self._stored(name, SCHEMAS[name])
        df = tenant_scope(df, self.tenant) if self.tenant is not None and "tenant_id" in df.columns else df
        return df if before is None else df.filter(F.col("batch") < before)

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The newest row per tenant and key, without deleted ones; of ``keys`` (``tenant_id, s3_key``) only, if given.

        Reads the newest snapshot below ``before`` and the batches after it.
        """
        rows, folded = self.read("manifest", before), self._stored("manifest_snapshots", f"{MANIFEST}, upto bigint")
        usable = folded if before is None else folded.filter(F.col("upto") < before)
        upto = usable.agg(F.max("upto")).first()[0]  # folder names only
        if upto is not None:
            kept = folded.filter(F.col("upto") == upto).drop("upto")
            rows = rows.filter(F.col("batch") > upto).unionByName(tenant_scope(kept, self.tenant) if self.tenant is not None else kept)
        if keys is not None:
            rows = rows.join(keys.select(*KEY), KEY, "left_semi")
        fields = [c for c in rows.columns if c not in KEY]
        newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*KEY, "r.*")
        return newest.filter(~F.col("deleted"))

    def snapshot(self, batch: int) -> None:
        """Store the manifest folded up to ``batch``; repeated, it replaces itself."""
        self.manifest(before=batch + 1).write.mode("overwrite").parquet(f"{self.root}/manifest_snapshots/upto={batch}")

    def compact(self, batch: int) -> None:
        """Bring all live chunks together in ``batch`` and empty the older batches of chunks and manifest.

        Chunks go first, then the manifest rows that name them, then a snapshot; until the manifest is there, the old
        batches stay the live ones. A repetition after that only empties them.
        """
        if self.read("manifest").filter(F.col("batch") == batch).isEmpty():
            self.write("chunks", self.live_chunks(), batch)
            self.write("manifest", self.manifest(before=batch).withColumn("chunk_batch", F.lit(batch).cast("bigint")), batch)
        self.snapshot(batch)
        for name in ("chunks", "manifest"):  # as many folders as batches since the last time
            older = self.read(name, before=batch).select("batch").distinct().collect()
            for row in older:
                self.write(name, self.spark.createDataFrame([], SCHEMAS[name]), row["batch"])

    def live_chunks(self) -> DataFrame:
        """Chunks of the batch that holds the current text of every source.

        Batches without a live source are not read. Of the others, keys alone tell which sources a later batch has
        replaced; these are stored and left out, so texts and vectors need not be shuffled to the manifest, which names
        every source there is.
        """
        key = ["tenant_id", "source", "batch"]
        current = persist_table(self.manifest().select("tenant_id", "source", F.col("chunk_batch").alias("batch")), "current")
        live = [r["batch"] for r in current.select("batch").distinct().collect() if r["batch"] is not None]  # as many as batches
        chunks = self.read("chunks").filter(F.col("batch").isin(live) & F.col("tenant_id").isNotNull() & F.col("source").isNotNull())
        gone = persist_table(chunks.select(*key).distinct().join(current, key, "left_anti"), "gone")
        return chunks.join(gone, key, "left_anti")

    def ledger(self) -> DataFrame:
        """Known ``(tenant_id, file_hash, source)`` with chunk counts."""
        n = self.live_chunks().groupBy("tenant_id", "source").agg(F.count("*").cast("int").alias("chunks"))
        return self.manifest().join(n, ["tenant_id", "source"], "left").groupBy("tenant_id", "file_hash").agg(
            F.max_by(F.struct("source", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("last_etag_at").alias("ingested_at")),
                     F.struct("batch", "source")).alias("r")).select("tenant_id", "file_hash", "r.*")

    def attempts(self) -> DataFrame:
        """The status log in the form that ``maintenance.dead_letter`` folds."""
        return self.read("status").filter(F.col("key").isNotNull()).select("tenant_id", "bucket", "key", "status", "error", "ts", F.col("batch").alias("event_id"))

    def outcomes(self) -> DataFrame:
        """The status log as a stream, for ``streaming.retries``; compaction leaves it as it is."""
        log = self.spark.readStream.schema(SCHEMAS["status"]).parquet(f"{self.root}/status")
        return log.filter(F.col("key").isNotNull())


def _split_schema(ddl: str) -> list[str]:
    return [c.strip() for c in ddl.split(", ")]


# --- whole tables -----------------------------------------------------------------------

def append_chunks(df: DataFrame, path: str) -> None:
    """Add rows to a chunk table that is partitioned by tenant and category."""
    df.write.mode("append").partitionBy("tenant_id", "category").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Wipe and reload; ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


def clear_index(spark: SparkSession, *paths: str) -> None:
    """Empty tables but keep their schema. Clears ledger and manifest together with the chunks."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        replace_table(spark.createDataFrame([], schema), path)


def write_index(chunks: DataFrame, hashes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Whole index: chunks with vectors, and known file hashes."""
    chunks.write.mode("overwrite").format(fmt).save(f"{path}/chunks")
    hashes.write.mode("overwrite").format(fmt).save(f"{path}/file_hashes")


def read_index(spark: SparkSession, path: str, chunk_schema, hash_schema, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(chunk_schema).format(fmt).load(f"{path}/chunks"),
            spark.read.schema(hash_schema).format(fmt).load(f"{path}/file_hashes"))


def write_results(df: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    df.write.mode("overwrite").json(path)
