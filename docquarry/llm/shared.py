"""Small helpers of the operators: intermediate tables in the shared folder, free column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import persist_table, shared_dir

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go when it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return persist_table(df, purpose)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def persist_by(df: DataFrame, purpose: str, column: str) -> DataFrame:
    """As ``persist``, in one folder for each value of ``column``."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``groups`` (a stored table with one row for each ``key``), rows without a group left out.

    ``size`` says how many of the ``total`` rows have the key. Fewer than ``share`` keys can hold more than
    ``total / share`` rows each; those are broadcast, and their rows stay where they are. The rest is joined by shuffle.
    """
    hot = F.broadcast(groups.filter(F.col(size) * share > total))
    cold = groups.filter(F.col(size) * share <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def free_names(df: DataFrame, added: Iterable[str]) -> list[str]:
    """Columns of ``df`` without those that an operator's result replaces (names differ by more than case)."""
    taken = {c.lower() for c in added}
    return [c for c in df.columns if c.lower() not in taken]
