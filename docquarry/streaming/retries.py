"""Retry state of failed deliveries, kept by the stream itself.

For each (tenant, bucket, key) the state holds how often delivery failed in a
row. A failure below the limit is routed to ``retry``; the one that reaches the
limit goes to ``dead_letter`` and ends the count, as does a success. A count
that saw nothing for ``forget`` is over: a later failure starts a new one, and
an event-time timer drops the state. Results follow from the events' own times,
not from when a timer happens to fire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docquarry.functions import fixed

KEY = ["tenant_id", "bucket", "key"]
ROUTES = "tenant_id string, bucket string, key string, attempts int, route string, error string, ts timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class RetryState(StatefulProcessor):
    """Counts failures in a row of one key."""

    def __init__(self, limit: int, forget_ms: int):
        self.limit, self.forget = limit, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "attempts int, last_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # rows of a key in one trigger come in any order
        batch = pd.concat(list(rows)).sort_values(["ts", "status", "error"], kind="stable")
        attempts, last = self.count.get() if self.count.exists() else (0, None)
        out = []
        for status, error, ts in zip(batch["status"], batch["error"], batch["ts"]):
            now = int(ts.value // 1_000_000)
            if status != "failed" or (last is not None and now - last > self.forget):
                attempts = 0
            last = now
            if status == "failed":
                attempts += 1
                done = attempts >= self.limit
                out.append((*(None if pd.isna(k) else k for k in key), attempts, "dead_letter" if done else "retry", None if pd.isna(error) else error, ts))
                attempts = 0 if done else attempts
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if attempts:
            self.count.update((attempts, last))
            self.handle.registerTimer(last + self.forget)
        elif self.count.exists():
            self.count.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROUTES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


def retry_routes(outcomes: DataFrame, limit: int = fixed.MAX_ATTEMPTS, forget: str = "1 day") -> DataFrame:
    """Where each failed delivery goes: a stream of ``tenant_id, bucket, key, attempts, route, error, ts``.

    outcomes: a stream of ``tenant_id, bucket, key, status, error, ts``; a status other than ``failed`` ends a count.
    Needs the RocksDB state store (``use_rocksdb``). Events later than ``forget`` behind the newest are dropped.
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    rows = outcomes.select(*KEY, "status", "error", "ts").withWatermark("ts", forget)
    return rows.groupBy(*KEY).transformWithStateInPandas(RetryState(limit, forget_ms), ROUTES, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


def start_routing(outcomes: DataFrame, out: str, checkpoint: str, *, limit: int = fixed.MAX_ATTEMPTS, forget: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Keep ``out`` (Parquet) in step with a stream of outcomes, such as the status log read as a stream."""
    use_rocksdb(outcomes.sparkSession)
    return (retry_routes(outcomes, limit, forget).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTES).parquet(path)


def open_retries(routes: DataFrame) -> DataFrame:
    """The newest route of each key that is still to be retried."""
    newest = routes.groupBy(*KEY).agg(F.max_by(F.struct("attempts", "route", "error", "ts"), F.struct("ts", "attempts")).alias("r"))
    return newest.select(*KEY, "r.*").filter("route = 'retry'")
