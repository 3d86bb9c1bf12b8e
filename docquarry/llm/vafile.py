"""Exact top-k by inner product with vector-approximation files.

Vectors become integers, ``floor(scale * x)`` per component. Queries and
vectors are dealt into tiles; each pair of tiles is one task. A tile of vectors
keeps an approximation file: per component the number of a cell of equal width.
A scan of the cells bounds every score from above; exact vectors are then read
in the order of the bounds until the k-th best exact score beats every bound
left. The k best of all tiles are merged by a window.

No tile holds more than about ``tile_rows`` vectors and ``tile_queries``
queries. A row meets each tile of the other side once, so a third of all rows
in one value changes nothing: tiles are dealt by a hash of the whole row.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; a query meets only vectors of its own length; ties go
to the smaller id; repeated candidate rows count each; repeated query rows
count once; rows with the query's id are not its candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, query_row long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v, dim) with ``v`` of integers; rows that take no part are left out."""
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (plain.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
            .select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"), F.size("v").alias("dim")))


def matrix(column: pa.ChunkedArray, picked: np.ndarray, dim: int) -> np.ndarray:
    """The rows ``picked`` of a list column, all of length ``dim``."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[at[picked][:, None] + np.arange(dim)]


def search_tile(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bits: int):
    """Yields (query position, ids, scores): the k best of a tile for each query, all if fewer."""
    reach = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * vectors.shape[1]
    kind = np.float64 if reach < 1 << 52 else object
    low = vectors.min(axis=0)
    width = np.maximum(1, -((low - vectors.max(axis=0) - 1) // (1 << bits)))
    cells = ((vectors - low) // width).astype(np.uint16)  # the approximation file
    floor = (low + cells * width).astype(kind)
    above, below = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    for first in range(0, len(queries), 64):
        part = slice(first, first + 64)
        # the best corner of the cell: its top where the query is positive, its floor elsewhere
        bound = (above[part] + below[part]) @ floor.T + (above[part] @ (width - 1).astype(kind))[:, None]
        for row, query in enumerate(range(first, min(first + 64, len(queries)))):
            allowed = np.flatnonzero(ids != query_ids[query])
            if not len(allowed):
                continue
            own = bound[row][allowed]
            order = np.argsort(-own, kind="stable")
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, object if kind is object else np.int64)
            done, step = 0, max(64, 4 * k)
            while done < len(order) and (len(best) < k or own[order[done]] >= best[-1]):
                read = allowed[order[done : done + step]]
                exact = vectors[read].astype(best.dtype) @ queries[query].astype(best.dtype)
                best_ids, best = np.concatenate([best_ids, ids[read]]), np.concatenate([best, exact])
                rank = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[rank], best[rank]
                done += step
                step *= 2
            yield query, best_ids, best


def _tile(k: int, bits: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            sizes = vectors.column("dim").to_numpy()
            asked = queries.column("dim").to_numpy()
            ids, query_ids = vectors.column("id").to_numpy(), queries.column("id").to_numpy()
            rows = queries.column("query_row").to_numpy()
            for dim in np.intersect1d(sizes, asked).tolist():
                own, mine = np.flatnonzero(sizes == dim), np.flatnonzero(asked == dim)
                found = search_tile(ids[own], matrix(vectors.column("v"), own, dim), query_ids[mine],
                                    matrix(queries.column("v"), mine, dim), k, bits)
                for query, best_ids, best in found:
                    out[0] += [int(query_ids[mine[query]])] * len(best)
                    out[1] += [int(rows[mine[query]])] * len(best)
                    out[2] += best_ids.tolist()
                    out[3] += best.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "query_row", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                scale: float = 1024, bits: int = 4, tile_rows: int = 32_768, tile_queries: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for every row of ``queries``."""
    n_vectors, n_queries = vectors.count(), queries.count()
    across, down = max(1, -(-n_vectors // tile_rows)), max(1, -(-n_queries // tile_queries))
    own = whole_numbers(vectors, id_col, vec_col, scale)
    own = own.withColumn("across", F.pmod(F.xxhash64("id", "v"), F.lit(across)))
    own = own.withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    asked = whole_numbers(queries, id_col, vec_col, scale).dropDuplicates().withColumn("query_row", F.xxhash64("v"))
    asked = asked.withColumn("down", F.pmod(F.xxhash64("id", "v"), F.lit(down)))
    asked = asked.withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    found = own.groupBy("across", "down").cogroup(asked.groupBy("across", "down")).applyInArrow(_tile(k, bits), FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
