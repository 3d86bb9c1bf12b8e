"""Best-k scoring of a table of questions against a table of chunks.

Every question has to meet every chunk, but neither a cross join nor the full
score matrix is ever built. The questions are packed into a block whose size is
checked; each task streams its share of the chunks through the block in Arrow
batches and emits only the best ``k`` per question. A window over those
partial lists gives the exact result. Several lists (``Ranking``) share one
pass over the chunks.

Before, a sample of the chunks is scored the same way. Its k-th best score is a
floor for the final k-th best, so the pass emits only what reaches the floor:
about ``k / sample`` rows for a question, however many tasks there are. The
floors travel with the questions; they never change the result.

Two ways to bring a block to the chunks:

* up to ``MAX_BLOCK`` questions: the block is sent to every task, the chunk
  table is read in place, without a shuffle;
* beyond that: questions and chunks are spread over a grid of hashed cells
  (blocks x slices) and co-grouped, so that no task ever holds more than one
  block and one slice. Its shuffle is chunks x blocks + questions x slices, so
  blocks and slices are as large as a task can hold.

Ids are integers or strings; ties are broken by chunk id everywhere. A question
with a ``scope`` sees the chunks of that scope only, a question with
``principals`` only chunks that one of their ``grants`` is among.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from docquarry.session import persist_table, small_batches

MAX_BLOCK = 4096              # questions per block
MAX_BLOCK_BYTES = 64 << 20    # serialized size of a block that is sent to the tasks
SLICE_ROWS = 50_000           # chunks per grid cell
GRID_BLOCKS = 2               # grid cells hold this many times MAX_BLOCK questions
SAMPLE = 1 / 64               # share of the chunks that gives the floors
CELLS = 1 << 18               # scores held at once while streaming
TEXT_ROWS = 256               # texts held as Python strings at once


@dataclass(frozen=True)
class Ranking:
    """One list of a pass: its name, how chunks are scored, how many are kept."""

    name: str
    kind: type
    k: int


def ids_of(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them: integers, or UTF-8 bytes."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return np.array([i.encode() for i in ids.to_pylist()], "S") if len(ids) else np.empty(0, "S1")


class BestK:
    """Running best ``k`` per question as flat arrays (question, score, id)."""

    def __init__(self, n_queries: int, k: int, floors: np.ndarray | None = None):
        self.n, self.k = n_queries, k
        self.low = np.full(n_queries, -np.inf) if floors is None else floors.astype(float)
        self.full = np.zeros(n_queries, bool)
        self.low_id = self.i = None
        self.q = np.empty(0, np.int64)
        self.s = np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # joined to the others when they are cut
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """A whole matrix, questions x chunks; -inf marks pairs that do not count."""
        qi, ci = np.nonzero((scores >= self.low[:, None]) & (scores > -np.inf))
        self.add_pairs(qi, scores[qi, ci], ids[ci])

    def add_pairs(self, qi: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        """Single pairs (question, score, id)."""
        reach = s >= self.low[qi]
        qi, s, i = qi[reach], s[reach], i[reach]
        if not qi.size:
            return
        if self.i is None:
            self.i, self.low_id = i[:0], np.zeros(self.n, i.dtype)
        better = (s > self.low[qi]) | ~self.full[qi] | (i < self.low_id[qi])
        self.new.append((qi[better], s[better], i[better]))
        self.held += int(better.sum())
        if self.held > 4 * self.n * self.k:
            self.cut()

    def cut(self) -> None:
        self.q, self.s, self.i = (np.concatenate(x) for x in zip((self.q, self.s, self.i), *self.new))
        self.new = []
        self._prune()
        order = np.lexsort((self.i, -self.s, self.q))
        q = self.q[order]
        place = np.arange(q.size) - np.searchsorted(q, np.arange(self.n))[q]
        order = order[place < self.k]
        self.q, self.s, self.i = self.q[order], self.s[order], self.i[order]
        count = np.bincount(self.q, minlength=self.n)
        full = np.nonzero(count == self.k)[0]
        last = np.cumsum(count)[full] - 1
        self.low_id = self.low_id.astype(np.promote_types(self.low_id.dtype, self.i.dtype))
        self.low[full], self.low_id[full], self.full[full] = self.s[last], self.i[last], True
        self.held = self.q.size

    def _prune(self) -> None:
        """Drop what is below its question's k-th best score, which a sort of plain numbers tells, so that few rows are put in order.

        Question and score make one number that never falls as the score falls, so rounding can only keep more.
        """
        count = np.bincount(self.q, minlength=self.n)
        more = np.nonzero(count > self.k)[0]
        if not more.size:
            return
        best, least = self.s.max(), self.s.min()
        place = self.q + (best - self.s) / (2 * (best - least) or 1.0)
        last = np.full(self.n, np.inf)
        last[more] = np.sort(place)[(np.cumsum(count) - count)[more] + self.k - 1]
        kept = place <= last[self.q]
        self.q, self.s, self.i = self.q[kept], self.s[kept], self.i[kept]

    def table(self, name: str, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch | None:
        if self.i is None:
            return None
        self.cut()
        ids = pa.array(self.i, id_type) if self.i.dtype.kind != "S" else pa.array([i.decode() for i in self.i.tolist()], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(self.q)), query_ids.take(pa.array(self.q)), ids, pa.array(self.s, pa.float64())], names=["list", "query_id", "id", "score"])


class VectorBlock:
    """Questions as rows of one matrix; a batch of chunks costs one product. Chunks that are not ``usable`` do not count."""

    needs = ("query_vec",)

    def __init__(self, questions: pa.Table):
        m = matrix(questions["query_vec"].combine_chunks())
        self.m = m / np.linalg.norm(m, axis=1, keepdims=True)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        at = batch.schema.get_field_index("usable")
        if at < 0:
            return self.of(batch.column(batch.schema.get_field_index("embedding")))
        usable = batch.column(at)
        out = np.full((len(self.m), batch.num_rows), -np.inf)
        out[:, usable.to_numpy(zero_copy_only=False)] = self.of(batch.column(batch.schema.get_field_index("embedding")).filter(usable))
        return out

    def of(self, embeddings: pa.Array) -> np.ndarray:
        if not len(embeddings):
            return np.empty((len(self.m), 0))
        e = matrix(embeddings)
        return np.round(self.m @ e.T / np.linalg.norm(e, axis=1), 6) + 0.0

    def reaching(self, batch: pa.RecordBatch, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (question, chunk, score) of ``scores`` that reach each question's ``low``; only near ones are rounded."""
        at, column = batch.schema.get_field_index("usable"), batch.column(batch.schema.get_field_index("embedding"))
        used = np.arange(batch.num_rows) if at < 0 else np.nonzero(batch.column(at).to_numpy(zero_copy_only=False))[0]
        column = column if at < 0 else column.filter(batch.column(at))
        if not len(column):
            return used[:0], used[:0], np.empty(0)
        e = matrix(column)
        raw = self.m @ e.T
        raw /= np.linalg.norm(e, axis=1)
        qi, ci = np.divmod(np.flatnonzero(raw >= low[:, None] - 1e-6), len(e))
        s = np.round(raw[qi, ci], 6) + 0.0
        near = s >= low[qi]
        return qi[near], used[ci[near]], s[near]


class TermBlock:
    """All question words in one matcher; each text is walked once.

    A word counts when the text (or the source name, if given) contains it. With
    source names, a word also counts when it and a name token of three or more
    characters start alike.
    """

    needs = ("terms", "weights")

    def __init__(self, questions: pa.Table):
        terms, weights = questions["terms"].to_pylist(), questions["weights"].to_pylist()
        self.number: dict[str, int] = {}
        postings: list[dict[int, float]] = []
        for q, (ts, ws) in enumerate(zip(terms, weights)):
            for t, w in zip(ts, ws):
                n = self.number.setdefault(t, len(postings))
                if n == len(postings):
                    postings.append({})
                postings[n][q] = postings[n].get(q, 0.0) + w
        self.total = np.array([sum(ws) for ws in weights], float)
        self.start = np.cumsum([0] + [len(p) for p in postings])
        self.post_q = np.array([q for p in postings for q in p], np.int64)
        self.post_w = np.array([w for p in postings for w in p.values()], float)
        self.sorted_terms = sorted(self.number)
        self.find = matcher(self.number)
        self._prefix_cache: dict[str, frozenset[int]] = {}

    def _prefix_hits(self, source: str) -> frozenset[int]:
        import bisect
        import regex

        hit = self._prefix_cache.get(source)
        if hit is None:
            found: set[int] = set()
            for token in regex.findall(r"[\p{L}\p{N}_]+", source):
                if len(token) < 3:
                    continue
                found.update(self.number[token[:n]] for n in range(1, len(token) + 1) if token[:n] in self.number)
                at = bisect.bisect_left(self.sorted_terms, token)
                while at < len(self.sorted_terms) and self.sorted_terms[at].startswith(token):
                    found.add(self.number[self.sorted_terms[at]])
                    at += 1
            hit = frozenset(found)
            if len(self._prefix_cache) > 10_000:
                self._prefix_cache.clear()
            self._prefix_cache[source] = hit
        return hit

    def hits(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        at = batch.schema.get_field_index("source")
        names = batch.column(at).to_pylist() if at >= 0 else None
        for i, text in enumerate(strings(batch, "text")):
            found = self.find(text or "")
            if names is not None:
                found |= self.find(names[i] or "")
                found |= self._prefix_hits(names[i] or "")
            yield np.fromiter(found, np.int64, len(found))

    def weight(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty((len(self.total), batch.num_rows))
        for i, found in enumerate(self.hits(batch)):
            found.sort()
            n = self.start[found + 1] - self.start[found]
            at = np.repeat(self.start[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[:, i] = np.bincount(self.post_q[at], self.post_w[at], len(self.total))
        return out

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.round(self.weight(batch) / self.total[:, None], 9) + 0.0


class TokenBlock:
    """Counts the tokens that a chunk's token list shares with each question, once each."""

    needs = ("tokens",)

    def __init__(self, questions: pa.Table):
        self.n = len(questions)
        askers: dict[str, list[int]] = {}
        for q, tokens in enumerate(questions["tokens"].to_pylist()):
            for t in set(tokens):
                askers.setdefault(t, []).append(q)
        self.askers = {t: np.array(qs) for t, qs in askers.items()}

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((self.n, batch.num_rows))
        for i, tokens in enumerate(batch.column(batch.schema.get_field_index("tokens")).to_pylist()):
            for t in tokens:
                if t in self.askers:
                    out[self.askers[t], i] += 1
        return out


class CountedTokenBlock(TokenBlock):
    """Counts a token as often as the question has it."""

    def __init__(self, questions: pa.Table):
        self.n = len(questions)
        askers: dict[str, dict[int, int]] = {}
        for q, tokens in enumerate(questions["tokens"].to_pylist()):
            for t in tokens:
                mine = askers.setdefault(t, {})
                mine[q] = mine.get(q, 0) + 1
        self.askers = {t: (np.array(list(qs)), np.array(list(qs.values()), float)) for t, qs in askers.items()}

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, self.n))  # a chunk's scores lie together while they are counted
        for i, tokens in enumerate(batch.column(batch.schema.get_field_index("tokens")).to_pylist()):
            for t in tokens or ():
                if t in self.askers:
                    at, times = self.askers[t]
                    out[i, at] += times
        return out.T


class TermThenVectorBlock:
    """Orders by words found, then by similarity, folded into one number.

    Words found count in steps of four; the similarity, shifted to 1..3, stays
    below one step.
    """

    needs = ("terms", "weights", "query_vec")

    def __init__(self, questions: pa.Table):
        self.terms, self.vectors = TermBlock(questions), VectorBlock(questions)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return 4 * self.terms.weight(batch) + self.vectors.scores(batch) + 2

    @staticmethod
    def parts(score: Column) -> tuple[Column, Column]:
        found = F.floor(score / 4)
        return found, F.round(score - 4 * found - 2, 6)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def strings(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """A column of long texts as Python strings, a few at once."""
    column = batch.column(batch.schema.get_field_index(name))
    for start in range(0, len(column), TEXT_ROWS):
        yield from column.slice(start, TEXT_ROWS).to_pylist()


def matcher(number: dict[str, int]) -> Callable[[str], set[int]]:
    if not number:
        return lambda text: set()
    machine = ahocorasick.Automaton()
    for t, n in number.items():
        machine.add_word(t, n)
    machine.make_automaton()
    return lambda text: {n for _, n in machine.iter(text)}


def _scope_mask(questions: pa.Table, column: str = "scope", strict: bool = False) -> Callable[[pa.RecordBatch], np.ndarray | None]:
    """Questions with a scope see only the chunks of that scope; those without see all, or nothing if ``strict``."""
    if column not in questions.column_names or (not strict and questions[column].null_count == len(questions)):
        return lambda batch: None
    wanted = np.array(questions[column].to_pylist(), object)
    free = np.array([w is None for w in wanted], bool) & (not strict)
    set_here = np.array([w is not None for w in wanted], bool)

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        have = np.array(batch.column(batch.schema.get_field_index(column)).to_pylist(), object)
        return free[:, None] | (set_here[:, None] & (wanted[:, None] == have[None, :]))

    return mask


def _grant_mask(questions: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray | None]:
    """Questions see only chunks with a grant among their principals; one bitmap of questions for each principal."""
    if "principals" not in questions.column_names:
        return lambda batch: None
    holders: dict[str, np.ndarray] = {}
    for q, names in enumerate(questions["principals"].to_pylist()):
        for name in names or ():
            holders.setdefault(name, np.zeros(len(questions), bool))[q] = True
    none, known = np.zeros(len(questions), bool), {}

    def allowed(grants: tuple[str, ...]) -> np.ndarray:
        if grants not in known:
            if len(known) > 10_000:
                known.clear()
            known[grants] = np.logical_or.reduce([holders[g] for g in grants if g in holders] or [none])
        return known[grants]

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        grants = batch.column(batch.schema.get_field_index("grants")).to_pylist()
        return np.stack([allowed(tuple(g or ())) for g in grants], axis=1) if grants else np.empty((len(questions), 0), bool)

    return mask


class _Run:
    """One ranking over a stream of chunks, for the questions that have what it needs."""

    def __init__(self, ranking: Ranking, questions: pa.Table):
        has = np.logical_and.reduce([questions[c].is_valid().to_numpy() for c in ranking.kind.needs])
        questions = questions.filter(pa.array(has, pa.bool_())).combine_chunks()
        self.name, self.ids = ranking.name, questions["query_id"].combine_chunks()
        self.block = ranking.kind(questions) if len(questions) else None
        self.masks = _scope_mask(questions), _scope_mask(questions, "tenant_id", strict=True), _grant_mask(questions)
        floor = f"floor_{ranking.name}"
        floors = questions[floor].fill_null(-np.inf).to_numpy() if floor in questions.column_names else None
        self.best = BestK(len(questions), ranking.k, floors)
        self.step = max(1, CELLS // max(1, len(questions)))
        self.id_type: pa.DataType | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        if self.block is None:
            return
        for start in range(0, batch.num_rows, self.step):
            part = batch.slice(start, self.step)
            ids = part.column(part.schema.get_field_index("id"))
            self.id_type = ids.type
            masks = [seen for seen in (mask(part) for mask in self.masks) if seen is not None]
            if not masks and hasattr(self.block, "reaching"):
                qi, ci, s = self.block.reaching(part, self.best.low)
                self.best.add_pairs(qi, s, ids_of(ids)[ci])
                continue
            scores = self.block.scores(part)
            for seen in masks:
                scores = np.where(seen, scores, -np.inf)
            self.best.add(scores, ids_of(ids))

    def table(self) -> pa.RecordBatch | None:
        return None if self.id_type is None else self.best.table(self.name, self.ids, self.id_type)


def bounded_block(questions: DataFrame, max_block: int = MAX_BLOCK) -> pa.Table | None:
    """The questions as one Arrow table, or None when they exceed a block."""
    head = questions.limit(max_block + 1).toArrow()
    return head if head.num_rows <= max_block and head.nbytes <= MAX_BLOCK_BYTES else None


def meet(
    fold: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    questions: DataFrame,
    chunks: DataFrame,
    schema: str,
    *,
    key: str = "query_id",
    chunk_key: str = "id",
    max_block: int = MAX_BLOCK,
    block: pa.Table | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Run ``fold(block of questions, batches of chunks)`` so that every pair meets once.

    ``block``, when given, is the whole question table already fetched by
    :func:`bounded_block`.
    """
    block = bounded_block(questions, max_block) if block is None else block
    if block is not None:
        sent = chunks.sparkSession.sparkContext.broadcast(block)

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from fold(sent.value, batches)

        return chunks.mapInArrow(in_place, schema)

    size = questions.agg(F.count("*").alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(size / (GRID_BLOCKS * max_block)))
    n_slices = max(1, math.ceil(chunks.count() / slice_rows))
    cell = ["_block", "_slice"]
    left = chunks.withColumn("_slice", F.pmod(F.xxhash64(chunk_key), F.lit(n_slices))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    right = questions.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks))).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)).cast("array<bigint>")))

    def in_cell(chunk_part: pa.Table, question_part: pa.Table) -> pa.Table:
        parts: list[pa.RecordBatch] = []
        if chunk_part.num_rows and question_part.num_rows:
            parts = list(fold(question_part.drop_columns(cell), iter(chunk_part.drop_columns(cell).to_batches())))
        return pa.Table.from_batches(parts) if parts else arrow_schema.empty_table()

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    # cells cost by their pairs: partitions merged by their few bytes would leave them to a few tasks
    left = left.repartition(max(n_blocks * n_slices, chunks.sparkSession.sparkContext.defaultParallelism), *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(in_cell, schema)


def partial_lists(rankings: list[Ranking], questions: DataFrame, chunks: DataFrame, *, max_block: int = MAX_BLOCK, block: pa.Table | None = None,
                  **options) -> DataFrame:
    """Per-task best chunks of each list: ``(list, query_id, id, score)``, all in one pass over the chunks."""
    def fold(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [_Run(r, part) for r in rankings]
        for batch in batches:
            for run in runs:
                run.add(batch)
        yield from (t for t in (run.table() for run in runs) if t is not None)

    types = questions.schema["query_id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()
    return meet(fold, questions, chunks, "list string, query_id {}, id {}, score double".format(*types), max_block=max_block, block=block, **options)


def best_of(partial: DataFrame, rankings: list[Ranking]) -> DataFrame:
    """Merge partial lists: ``(list, query_id, id, score, rank)``, rank from 1."""
    most = max(r.k for r in rankings)
    w = Window.partitionBy("list", "query_id").orderBy(F.col("score").desc(), "id")
    kept = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    for r in rankings:
        if r.k < most:
            kept = kept.filter((F.col("list") != r.name) | (F.col("rank") <= r.k))
    return kept


def floors_of(rankings: list[Ranking], found: DataFrame) -> DataFrame:
    """(query_id, floor_<list> …) from the lists of a sample: the k-th best score, where there are as many."""
    last = [F.max(F.when((F.col("list") == r.name) & (F.col("rank") == r.k), F.col("score"))).alias(f"floor_{r.name}") for r in rankings]
    return found.groupBy("query_id").agg(*last)


def best_lists(rankings: list[Ranking], questions: DataFrame, chunks: DataFrame, *, max_block: int = MAX_BLOCK, sample: float = SAMPLE,
               block: pa.Table | None = None, **options) -> DataFrame:
    """The exact best chunks of several lists: ``(list, query_id, id, score, rank)``.

    questions: query_id and what the kinds of the lists need (null: the question is not in that list), and, if wanted,
    ``scope`` and ``principals``. chunks: id and what the kinds read, and ``scope``, ``grants``. ``block`` is the whole
    question table, where it has been fetched already. ``sample=0`` does without floors.
    """
    block = bounded_block(questions, max_block) if block is None else block
    if sample:
        seeded = best_of(partial_lists(rankings, questions, chunks.sample(sample, seed=11), max_block=max_block, block=block, **options), rankings)
        floors = floors_of(rankings, seeded)
        if block is None:
            questions = questions.join(floors, "query_id", "left")
        else:  # as many rows as the block at most
            with small_batches(chunks.sparkSession):
                found = {r["query_id"]: r for r in floors.collect()}
            for r in rankings:
                name = f"floor_{r.name}"
                block = block.append_column(name, pa.array([found[q][name] if q in found else None for q in block["query_id"].to_pylist()], pa.float64()))
    return best_of(partial_lists(rankings, questions, chunks, max_block=max_block, block=block, **options), rankings)


def stored_lists(rankings: list[Ranking], questions: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """:func:`best_lists`, run at once in small batches and stored, so that a worker holds few texts however large the partitions are."""
    found = best_lists(rankings, questions, chunks, **options)
    with small_batches(chunks.sparkSession):
        return persist_table(found, "lists")


def best_k(kind: type, questions: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
    """The exact best ``k`` chunks of a single list: ``(query_id, id, score, rank)``."""
    return best_lists([Ranking("best", kind, k)], questions, chunks, **options).drop("list")


def scoped(df: DataFrame, scope: str | None) -> list[Column]:
    return [F.col(scope).alias("scope")] if scope and scope in df.columns else []


def permitted(df: DataFrame) -> list[Column]:
    """``principals`` of questions and ``grants`` of chunks, where the table has them."""
    return [F.col(c) for c in ("principals", "grants") if c in df.columns]


def one_tenant(questions: DataFrame, chunks: DataFrame) -> tuple[list[Column], DataFrame]:
    """The tenant column, if both sides know tenants, and the chunks of the tenants that ask; folders of others are not read."""
    if "tenant_id" not in questions.columns or "tenant_id" not in chunks.columns:
        return [], chunks
    # Spark prunes folders at run time only by a side that has a filter
    asking = questions.select("tenant_id").filter(F.length("tenant_id") > 0).distinct()
    return [F.col("tenant_id")], chunks.join(asking, "tenant_id", "left_semi")
