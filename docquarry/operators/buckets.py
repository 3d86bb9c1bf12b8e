"""Approximate semantic search over hash buckets that are stored with the index.

Vectors of length one are hashed by Spark ML's bucketed random projections.
``planes`` of its hashes together name a bucket, and there are ``tables`` such
namings. The bucket table has a row for each chunk and naming, with the vector,
in folders by ``slot`` (of the bucket's hash) and sorted by bucket: a search is
an equi-join of the questions' buckets with it, so only their slots are read
(dynamic partition pruning) and in those the row groups of their buckets.
Candidates are scored exactly. A question also asks for the buckets next to its
own (one step up or down along one plane), which costs no storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions.vectors import dot
from docquarry.operators import scoring
from docquarry.operators.semantic import valid_vectors


@dataclass(frozen=True)
class Hashing:
    """Shape of the bucket table; more tables or wider steps find more and read more."""

    tables: int = 8
    planes: int = 4
    step: float = 0.25
    slots: int = 64
    seed: int = 7


def unit(vector: Column) -> Column:
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


@dataclass(frozen=True)
class Projections:
    """Fitted hashes of vectors of one dimension."""

    model: BucketedRandomProjectionLSHModel
    dimension: int
    hashing: Hashing


def fit_hashing(spark: SparkSession, dimension: int, hashing: Hashing = Hashing()) -> Projections:
    """The projections; they depend on the dimension and the seed only, so an index of any size has the same."""
    one = spark.range(1).select(array_to_vector(F.array_repeat(F.lit(1.0), dimension)).alias("unit"))
    hashes = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=hashing.step, numHashTables=hashing.tables * hashing.planes, seed=hashing.seed)
    return Projections(hashes.fit(one), dimension, hashing)


def _named(rows: DataFrame, to: Projections, probes: bool) -> DataFrame:
    """``rows`` (with ``unit``) once for each naming (and, with ``probes``, for the buckets next to it): slot, bucket."""
    hashing = to.hashing
    hashed = to.model.transform(rows.withColumnRenamed("unit", "kept").withColumn("unit", array_to_vector(F.col("kept")))).drop("unit").withColumnRenamed("kept", "unit")
    steps = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("int"))
    rows = hashed.withColumn("steps", steps).drop("hashes").withColumn("naming", F.explode(F.sequence(F.lit(0), F.lit(hashing.tables - 1))))
    rows = rows.withColumn("steps", F.slice("steps", F.col("naming") * hashing.planes + 1, F.lit(hashing.planes)))
    if probes:
        moves = [[0] * hashing.planes] + [[d if p == i else 0 for p in range(hashing.planes)] for i in range(hashing.planes) for d in (-1, 1)]
        rows = rows.withColumn("move", F.explode(F.array(*(F.array(*map(F.lit, m)) for m in moves)))).withColumn(
            "steps", F.zip_with("steps", "move", lambda s, m: s + m)).drop("move")
    bucket = F.xxhash64("naming", "steps")
    return rows.withColumn("bucket", bucket).withColumn("slot", F.pmod(F.col("bucket"), F.lit(hashing.slots)).cast("int")).drop("naming", "steps")


def write_buckets(chunks: DataFrame, path: str, to: Projections, mode: str = "append") -> None:
    """Adds the buckets of ``chunks`` (id, embedding) to the table at ``path``, with vectors of length one; a large slot is split over tasks."""
    rows = _named(valid_vectors(chunks).select("id", unit(F.col("embedding")).alias("unit")), to, probes=False)
    rows.hint("rebalance", "slot").sortWithinPartitions("slot", "bucket").write.mode(mode).partitionBy("slot").parquet(path)


def _scored(asked: pa.Table, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stored rows with the questions that ask for their bucket, to the best pairs of a task; a stored vector comes once for all of them."""
    numbers = {q: n for n, q in enumerate(asked["query_id"].to_pylist())}
    vectors = scoring.matrix(asked["unit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = scoring.BestK(len(numbers), depth), None
        for batch in batches:
            ids, kind = scoring.ids_of(batch.column(0)), batch.column(0).type
            lists = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            qi = np.fromiter((numbers[q] for q in lists.flatten().to_pylist()), np.int64, len(rows))
            unit_rows = scoring.matrix(batch.column(1))
            for start in range(0, len(rows), 1 << 18):
                r, q = rows[start:start + (1 << 18)], qi[start:start + (1 << 18)]
                best.add_pairs(q, np.round(np.einsum("ij,ij->i", vectors[q], unit_rows[r]), 6) + 0.0, ids[r])
        table = None if kind is None else best.table("", asked["query_id"].combine_chunks(), kind)
        if table is not None:
            yield table.select(["query_id", "id", "score"])

    return run


def semantic_topk_buckets(questions: DataFrame, buckets: DataFrame, to: Projections, k: int = fixed.LIST_DEPTH, *, max_block: int = scoring.MAX_BLOCK) -> DataFrame:
    """Approximate best ``k`` chunks per question by cosine: ``(query_id, id, score, rank)``; only chunks that share a bucket are scored.

    Questions that fit a block meet a stored row once, as the list of those that ask for its bucket. A larger question
    table is joined by shuffle, pair by pair.
    """
    asked = valid_vectors(questions, "query_vec").select("query_id", unit(F.col("query_vec")).alias("unit"))
    probes = _named(asked, to, probes=True).filter(F.col("slot") >= 0)  # Spark prunes folders at run time only by a side that has a filter
    block = scoring.bounded_block(asked, max_block)
    if block is None:
        score = F.round(dot(F.col("unit"), F.col("asked")), 6).alias("score")
        met = buckets.join(probes.withColumnRenamed("unit", "asked"), ["slot", "bucket"]).select("query_id", "id", score)
    else:
        asking = F.broadcast(probes.groupBy("slot", "bucket").agg(F.collect_list("query_id").alias("asking")))  # the block bounds it
        types = asked.schema["query_id"].dataType.simpleString(), buckets.schema["id"].dataType.simpleString()
        # a pair is met in several buckets, so a task keeps as many rows as k pairs can have
        met = buckets.join(asking, ["slot", "bucket"]).select("id", "unit", "asking").mapInArrow(
            _scored(block, k * to.hashing.tables), "query_id {}, id {}, score double".format(*types))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    once = met.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
