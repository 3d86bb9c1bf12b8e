"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "docquarry", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting there is no place that is known to be shared, so the
    call fails; ``local_session`` and the tests set one of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and lets
    several consumers reuse one computation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs inside hands Python tasks ``rows`` rows at once at most.

    A worker holds two batches of whole texts; with Spark's 10,000 rows they
    grow with the partitions until they are full. The setting is put back.
    """
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of all tables ``df`` reads; runs nothing.

    Sums the leaves of the plan: the estimate of a whole plan multiplies the
    sides of joins and says little about the data. A leaf without an estimate
    counts as endless, as Spark reports it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


UNKNOWN_BYTES = 1 << 60
SPLIT_BYTES = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of an input that is too small to be split by itself.

    Work per row is what costs in text and vector steps, so a table of a few
    megabytes in one file should not run in one task. Tables with enough bytes
    per core come back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if input_bytes(df) < cores * SPLIT_BYTES else df


def fan_out(df: DataFrame, *keys: str, sized_by: DataFrame | None = None) -> DataFrame:
    """Spread rows over all cores by key, ahead of work that is heavy per row.

    Adaptive execution merges small partitions by bytes, which would leave such
    work to one task. The number of partitions is the number of cores, or what
    the bytes of ``sized_by`` call for. Later steps on the same keys reuse it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if sized_by is not None:
        size = input_bytes(sized_by)
        if size >= UNKNOWN_BYTES:
            return df.repartition(*keys)
        n = max(n, size // (64 << 20) + 1)
    return df.repartition(n, *keys)
