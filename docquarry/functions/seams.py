"""Where models plug in.

Each seam is an ordinary Spark step with a native, deterministic default. A
model comes in as ``load``, a function without arguments that returns a
callable; it runs once per Python worker, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from docquarry.functions.fixed import PERMISSIONS_KEY
from docquarry.functions.text import with_prefix, words
from docquarry.functions.vectors import stored

EMBED_DIM = 768


def embed_hashed(df: DataFrame, text: str, out: str = "embedding", *, dim: int = EMBED_DIM) -> DataFrame:
    """Hashed word counts of unit length; a text without words gets a zero vector."""
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(
        df.withColumn("_words", words(F.lower(text))))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, stored(vector_to_array("_unit"))).drop("_words", "_tf", "_unit")


def embed_model(df: DataFrame, text: str, load: Callable[[], Callable], out: str = "embedding", *,
                role: str = "document") -> DataFrame:
    """``load()`` gives ``list[str] -> list[list[float]]``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.tolist())))

    return df.withColumn(out, stored(run(with_prefix(F.col(text), role))))


def pair_scorer(load: Callable[[], Callable], chars: int = 512):
    """A scorer for :func:`docquarry.operators.fusion.rerank`.

    ``load()`` gives ``(list[str], list[str]) -> list[float]``.
    """

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, contents in batches:
            yield pd.Series(model(queries.tolist(), contents.tolist()), dtype="float64")

    return lambda query, content: run(query, F.substring(content, 1, chars))


def generator(packs: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """Model answers for context packs (``query_id, query, context``).

    ``load()`` gives ``(query, context) -> answer``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [model(q, c) for q, c in zip(b["query"], b["context"])]})

    return packs.select("query_id", "query", "context").mapInPandas(run, "query_id bigint, answer string")


def front_matter_yaml(load: Callable[[], Callable]):
    """A column function for headers in full YAML; ``load()`` gives ``str -> dict``."""

    @F.pandas_udf(StructType([
        StructField("visibility", StringType()), StructField("groups", ArrayType(StringType())),
        StructField("users", ArrayType(StringType()))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = load()
        for headers in batches:
            found = [((parse(h) or {}).get(PERMISSIONS_KEY) or {}) if h else {} for h in headers]
            yield pd.DataFrame({
                "visibility": [str(p.get("visibility", "public")).lower() if p else None for p in found],
                "groups": [[str(g) for g in p.get("groups") or []] if p else None for p in found],
                "users": [[str(u) for u in p.get("users") or []] if p else None for p in found]})

    return run
