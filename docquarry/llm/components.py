"""Connected components of links, as DataFrames throughout.

Tasks first contract their links with a union-find over batches of bounded
size; then rounds of large-star and small-star pull every node to the least
node it can reach. Links, labels and components never reach the driver; each
round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import persist

LINKS = "high long, low long"


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of each batch: links each node to the least node of its set."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, y) for x, y in pairs if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["high", "low"])


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (two columns of ids); the component is its least node."""
    a, b = (F.col(f"`{c}`") for c in links.columns)
    links = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low")
    links = persist(links.mapInArrow(contract, LINKS).distinct(), "links")
    before = _sum(links)
    while before[0]:
        # large star: the larger neighbours of a node move to the least of its neighbours and itself
        both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        # small star: a node and its smaller neighbours move to the least of those
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(least, "high")
        links_new = moved.select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high <> low").unionByName(
            least.select("high", F.col("least").alias("low"))).distinct()
        links = persist(links_new, "links")
        after = _sum(links)
        if after == before:
            break
        before = after
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
