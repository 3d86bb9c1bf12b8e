"""Language-model scores from a weighted backoff automaton over words.

Counts of all n-grams up to ``order`` of all training texts make a smoothed
model: p1(w) = (c(w) + a) / (N + a (V + 1)), and for longer contexts
p(w | h) = (c(h w) + k p(w | shorter h)) / (c(h) + k). As an automaton, a
context that was seen is a state; a seen n-gram is an arc with its log
probability; a state's failure arc leads to the state of the context without
its first word and costs log(k / (c(h) + k)). A text is scored in one
left-to-right traversal that carries the state and adds the weights.

The automaton is never built whole. Documents are dealt into blocks of about
``block_bytes``; a block states its distinct n-grams (64-bit hashes, sorted,
with the counts of its training documents) as packed rows, one for each range
of the hash space; each range is summed over all blocks by one task, which
answers with the totals in the order of the statement; then each block has just
the states and arcs that its own texts can reach. An n-gram reaches its range
once per block, however frequent it is, and no table of all n-grams exists.

Defined results: null text is empty and is the end token alone; a null id
belongs to the training rows; repeated rows are counted and scored each; with no
training row every token is unknown and scores log10(1 / (V + 1)), V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import words as W
from docquarry.llm.shared import free_names, persist

END = np.uint64(0x51ED270B7F14A3C5)
STATED = "range int, block long, keys binary, counts binary"
SUMMED = "block long, range int, totals binary, tokens long, kinds long"


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane; planes of zeros compress to nothing."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def token_grams(part: W.Words, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Token offsets of each document, and per order the n-gram hash ending at each token.

    The lowest bit of a hash is 1 for single tokens only. Where a document has
    fewer tokens before, the longer n-gram is the hash of the shorter one again.
    """
    docs = len(part.first) - 1
    first = part.first + np.arange(docs + 1)
    tokens = np.insert(W.hashes(part), part.first[1:], END)
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    one = tokens | np.uint64(1)
    out = [one]
    for n in range(2, order + 1):
        longer = np.empty_like(tokens)
        longer[:1] = 0
        longer[1:] = W.mix(out[-1][:-1] * np.uint64(W.BASE) + tokens[1:]) & ~np.uint64(1)
        out.append(np.where(place >= n - 1, longer, out[-1]))
    return first, out


def block_grams(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Token offsets, n-gram hashes per order, the sorted distinct hashes, and each token's places among them."""
    firsts, grams, seen = [np.zeros(1, np.int64)], [[] for _ in range(order)], 0
    for part in W.slices(texts, lower=True):
        first, own = token_grams(part, order)
        firsts.append(first[1:] + seen)
        seen += int(first[-1])
        for all_, one in zip(grams, own):
            all_.append(one)
    first, grams = np.concatenate(firsts), [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in grams]
    keys, places = np.unique(np.concatenate(grams), return_inverse=True)
    return first, grams, keys, np.split(places, order)


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The border of each of ``n`` even ranges of the hash space in sorted keys."""
    borders = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]]).astype(np.int64)


def _state(order: int, ranges: int):
    def run(key, table):
        first, grams, keys, places = block_grams(table.column("text"), order)
        training = np.repeat(~np.array(table.column("held_out").to_pylist(), bool), np.diff(first))
        counts = np.zeros(len(keys), np.int64)
        position = np.arange(len(training)) - np.repeat(first[:-1], np.diff(first))
        for n, place in enumerate(places):
            counts += np.bincount(place[training & (position >= n)], minlength=len(keys))
        borders = _ranges(keys, ranges)
        rows = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())) if hi > lo]
        return pa.table({
            "range": pa.array([r for r, _, _ in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "keys": pa.array([planes(np.diff(keys[lo:hi], prepend=np.uint64(0))) for _, lo, hi in rows], pa.binary()),
            "counts": pa.array([planes(counts[lo:hi]) for _, lo, hi in rows], pa.binary())})

    return run


def _sum(key, table):
    keys = [np.cumsum(from_planes(x)) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([from_planes(x, np.int64) for x in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, place, counts)
    single = (distinct & np.uint64(1)) == 1
    answers = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
    rows = len(keys)
    return pa.table({
        "block": table.column("block").cast(pa.int64()), "range": pa.array([key[0].as_py()] * rows, pa.int32()),
        "totals": pa.array([planes(a) for a in answers], pa.binary()),
        # of the whole range, told once
        "tokens": pa.array([int(totals[single].sum())] + [0] * (rows - 1), pa.int64()),
        "kinds": pa.array([int((totals[single] > 0).sum())] + [0] * (rows - 1), pa.int64())})


def traverse(first: list[int], arcs: list[list[float]], fails: list[list[float]], known: list[bool]) -> list[float]:
    """Scores of texts. ``arcs[n][i]``: weight of the arc by token i from its n-word context (nan: no such arc);
    ``fails[n][i]``: weight of the failure arc of the n-word context that ends before token i."""
    top = len(arcs) - 1
    scores = []
    for low, high in zip(first[:-1], first[1:]):
        state, total = 0, 0.0
        for i in range(low, high):
            weight = arcs[state][i]
            while weight != weight:
                total += fails[state][i]
                state -= 1
                weight = arcs[state][i]
            total += weight
            if state:
                state = min(state + 1, top)
            elif known[i]:
                state = min(1, top)
        scores.append(total)
    return scores


def _score(order: int, base: float, prior: float, tokens: int, kinds: int, columns: list[str]):
    def run(key, table, answers):
        if not table.num_rows:
            return pa.table([pa.nulls(0, f.type) for f in table.select(columns).schema] + [pa.nulls(0, pa.int64())] * 2 + [pa.nulls(0, pa.float64())] * 2,
                            names=[*columns, "n_tokens", "n_known", "base_score", "score"])
        first, grams, keys, places = block_grams(table.column("text"), order)
        parts = sorted(zip(answers.column("range").to_pylist(), answers.column("totals").to_pylist()))
        totals = np.concatenate([from_planes(x, np.int64) for _, x in parts])
        counts = [totals[p] for p in places]
        lower = (counts[0] + base) / (tokens + base * (kinds + 1))
        plain = np.log10(lower)
        arcs, fails = [plain], [np.zeros(len(plain))]
        position = np.arange(len(plain)) - np.repeat(first[:-1], np.diff(first))
        for n in range(1, order):
            before = np.concatenate([[0], counts[n - 1][:-1]])  # of the n-word context
            lower = (counts[n] + prior * lower) / (before + prior)
            arcs.append(np.where((counts[n] > 0) & (position >= n), np.log10(lower), np.nan))
            fails.append(np.log10(prior / (before + prior)))
            # contexts that were not seen have no arcs; their weights are never read
        known = counts[0] > 0
        scores = traverse(first.tolist(), [a.tolist() for a in arcs], [f.tolist() for f in fails], known.tolist())
        added = [pa.array(np.diff(first), pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), first[:-1]), pa.int64()),
                 pa.array(np.add.reduceat(plain, first[:-1]), pa.float64()), pa.array(scores, pa.float64())]
        return pa.table([*(table.column(c) for c in columns), *added], names=[*columns, "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, base: float = 0.1,
                prior: float = 4.0, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns of ``docs`` but the text, and ``held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10); columns of these names are replaced.

    The model learns from all rows where ``held_out`` is not true and scores all rows.
    """
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in free_names(docs, added) if c != text_col]
    inner = [f"c{i}" for i in range(len(names))]
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    text = F.col(f"`{text_col}`").cast("string")
    dealt = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(blocks)).alias("block"), *(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)),
                        text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    stated = dealt.select("block", "text", "held_out").groupBy("block").applyInArrow(_state(order, blocks), STATED)
    summed = persist(stated.groupBy("range").applyInArrow(_sum, SUMMED), "ngram-totals")
    tokens, kinds = summed.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    columns = [*inner, "held_out"]
    fields = [f for f in dealt.schema.fields if f.name in columns]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    answers = summed.select("block", "range", "totals")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, base, prior, tokens, kinds, columns), T.StructType(fields))
    return scored.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
