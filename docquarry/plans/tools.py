"""The five read-only tools, as table functions over request tables.

A tool loop asks one thing at a time; here a table of tool calls is answered by
one job per tool. Every tool takes requests and chunks and returns rows keyed by
``request_id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.operators import catalog
from docquarry.plans.retrieve import search_documents
from docquarry.session import persist_table


def summarize_document(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sections of the document that each request (``request_id, source``) means, in ``id`` order."""
    meant = persist_table(
        catalog.resolve_document(requests, chunks).filter(F.col("source").isNotNull()).select("request_id", "source"), "meant")
    wanted = chunks.join(meant.select("source").distinct(), "source", "left_semi")
    return catalog.document_sections(wanted).join(meant, "source").select(
        "request_id", "source", "location", "id", "content")


def search(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``request_id, query, query_vec, top_k, category`` to ranked chunks."""
    found = search_documents(requests.withColumnRenamed("request_id", "query_id"), chunks)
    return found.withColumnRenamed("query_id", "request_id")


LIST_REQUESTS = 512     # requests for the same files that travel as one list
PART_FILES = 1024       # files of a category that meet a list at once
TASK_ROWS = 4 << 20     # rows of the answer that a task makes


def list_files(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``request_id, category`` (null for all) to the file inventory.

    The answer has requests x files rows, and there are few categories to join on. So the requests for a category are
    dealt into lists and its files into parts, every list meets every part in a cell of its own, and tasks get cells by
    the rows that these make, not by the bytes that are read.
    """
    asked = persist_table(requests.select(
        "request_id", F.coalesce(F.concat(F.lit("="), "category"), F.lit("*")).alias("_key"), F.monotonically_increasing_id().alias("_row")), "asked")
    files = persist_table(catalog.inventory(chunks), "inventory")
    keyed = files.withColumn("_key", F.explode(F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), "category")))))

    def pieces(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("_key").agg(F.ceil(F.count("*") / size).alias(name), F.count("*").alias(f"_in{name}"))

    sizes = persist_table(pieces(asked, LIST_REQUESTS, "_lists").join(pieces(keyed, PART_FILES, "_parts"), "_key"), "cells")
    cells, rows = sizes.agg(F.coalesce(F.sum(F.col("_lists") * F.col("_parts")), F.lit(0)),
                            F.coalesce(F.sum(F.col("_in_lists").cast("double") * F.col("_in_parts")), F.lit(0.0))).first()
    tasks = min(max(cells, 1), max(4 * chunks.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))
    sizes, cell = sizes.select("_key", "_lists", "_parts"), ["_key", "_list", "_part"]
    lists = asked.join(sizes, "_key").groupBy("_key", F.pmod(F.xxhash64("_row"), "_lists").alias("_list"), "_parts").agg(F.collect_list("request_id").alias("_ids"))
    lists = lists.select("_key", "_list", "_ids", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1).cast("array<bigint>")).alias("_part"))
    parts = keyed.join(sizes, "_key").withColumn("_part", F.pmod(F.xxhash64("source"), "_parts")).withColumn(
        "_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1).cast("array<bigint>")))
    met = parts.repartition(tasks, *cell).join(lists.hint("shuffle_hash"), cell)
    return met.select(*files.columns, F.explode("_ids").alias("request_id"))


TOOLS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "search_documents": search,
    "read_chunk": catalog.read_chunk,
    "list_files": list_files,
    "compare_sections": catalog.compare_sections,
    "summarize_document": summarize_document,
}
assert list(TOOLS) == fixed.TOOL_NAMES


def calls_of(calls: DataFrame, tool: str, **types: str) -> DataFrame:
    """The requests in a table of calls (``request_id, tool, args``) that go to one tool.

    ``types`` names the arguments to take and their types; the first one is required.
    """
    wanted = calls.filter(F.col("tool") == tool).select(
        "request_id", *[F.try_element_at("args", F.lit(a)).cast(t).alias(a) for a, t in types.items()])
    return wanted.filter(F.col(next(iter(types))).isNotNull())


def register_views(spark: SparkSession, chunks: DataFrame, prefix: str = "kb") -> None:
    """Temporary views for SQL users: chunks, the file inventory, totals."""
    chunks.createOrReplaceTempView(f"{prefix}_chunks")
    catalog.list_files(chunks).createOrReplaceTempView(f"{prefix}_files")
    catalog.index_status(chunks).createOrReplaceTempView(f"{prefix}_status")
    catalog.chunks_by_type(chunks).createOrReplaceTempView(f"{prefix}_types")
