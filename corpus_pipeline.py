"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before kept; its decisions take effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.neardup import near_duplicates
from docquarry.llm.packing import pack
from docquarry.llm.registry import vocabulary
from docquarry.llm.rules import quality
from docquarry.llm.shared import persist
from docquarry.llm.substring import dedup_substrings
from docquarry.llm.toxicity import score, train


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    # the verdict follows from the text alone; only keys and verdicts are written, and the rows are met by them
    judged = quality(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_of"), "kept")
    good = persist(judged, "judged").filter("kept").select("_id", "_of").distinct()
    marked = docs.withColumn("_text", F.xxhash64("text"))
    return marked.join(good, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below 0.5, by a model of the labelled documents that came this far."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep_text=True).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): of least id, rows without an id last.

    Every pair of id and text is judged as a row of its own, under 63 bits of its hash; rows equal in both are one.
    """
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    found = near_duplicates(docs.select(key.alias("_key"), "text"), id_col="_key").select("_key", "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    kept = docs.select("doc_id", key.alias("_key")).join(found, "_key").groupBy("component_id").agg(F.min(rank).alias("r")).select("r._key")
    # rows equal in id and text may differ elsewhere
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*(others or ["_key"])))
    return docs.withColumn("_key", key).join(kept, "_key", "left_semi").withColumn("_rank", first).filter("_rank = 1").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without words of 20-word windows that start earlier; a text that lost words is its other words, joined by spaces."""
    done = dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_words")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_words")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).withColumn("text", text).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"), length=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

# SQL cannot say the toxicity stage; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
