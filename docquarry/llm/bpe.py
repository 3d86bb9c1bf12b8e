"""Byte-level BPE encoding and decoding with the ids of a rank file.

Texts are cut by the vocabulary's pattern. A piece's bytes are read as Latin-1,
so that one pass of an Aho-Corasick automaton over the vocabulary finds the
longest token at every byte. The encoder goes left to right, takes the longest
token that may follow the last one, falls back to shorter prefixes of it and,
where none fits, takes the last token back; a place once left is not tried
again, so the work is linear in the piece. Two tokens may stand side by side if
undoing their merges never meets a pair that the merge order would have joined
first; answers are memoised. The ids are those of applying the merges in order.

Defined results: null text is empty and has no ids; ids that are not in the
vocabulary cannot be decoded and raise an error; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.shared import free_names

CACHED_PIECES = 400_000
CACHED_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a file with a base64 token and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """Encoder for one vocabulary; ids are the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(token, i)
        self.fits = {}
        self.shorter = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            n = len(token) - 1
            while n and token[:n] not in ranks:
                n -= 1
            self.shorter[i] = ranks[token[:n]] if n else -1
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, token: bytes, i: int) -> None:
        """The two earlier tokens whose merge gives this one."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], i), self.ranks.get(token[cut:], i)
            if left < i and right < i and self.compatible(left, right):
                self.parts[i] = (left, right)
                self.joined[left, right] = i
                return
        self.parts[i] = (i, i)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can stand side by side in a finished encoding."""
        key = (left, right)
        answer = self.fits.get(key)
        if answer is None:
            if len(self.fits) > CACHED_PAIRS:
                self.fits = {}
            answer = self.fits[key] = self._undo(left, right)
        return answer

    def _undo(self, left: int, right: int) -> bool:
        """Undoes the later merge of the two again and again; a pair at the border that merges before it speaks against them."""
        bound = len(self.ranks) + 1
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            inner_left, inner_right = self.parts[left][1], self.parts[right][0]
            if inner_left == left and inner_right == right:
                return True
            # on equal ids the left merge came first, so the right one is undone first
            if inner_right == right or (left > right and inner_left != left):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest = [(-1, 0)] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > longest[start][1]:
                longest[start] = (i, size)
        usable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0][0]
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if usable[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][0] if at < n else -1
            else:
                usable[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return tuple(out)

    def encode(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            pass
        for piece in set(pieces):
            if piece not in known:
                known[piece] = self.encode_piece(piece)
        out = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > CACHED_PIECES:
            self.known = {}
        return out


def _encode(path: str, pattern: str, chunk: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pairs, cut = BytePairs(read_ranks(path)), regex.compile(pattern).findall
        for batch in batches:
            others = [c for c in batch.schema.names if c != "text"]
            low, sizes, ids = 0, [0], []
            read = 0
            texts = batch.column("text")
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                own = np.array(pairs.encode(cut(text)), np.int32)
                ids.append(own)
                sizes.append(sizes[-1] + len(own))
                read += len(text)
                if read >= chunk or row + 1 == batch.num_rows:
                    listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c)[low : row + 1] for c in others), listed], names=[*others, "ids"])
                    low, sizes, ids, read = row + 1, [0], [], 0

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in read_ranks(path).items()}.__getitem__
        for batch in batches:
            lists = batch.column("ids")
            out = []
            for row in range(batch.num_rows):
                ids = lists[row].values
                out.append(b"".join(map(tokens, ids.to_numpy().tolist())) if ids is not None else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``ids`` (array of int); a column of that name is replaced."""
    names = [c for c in free_names(docs, ["ids"]) if c != text_col]
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*(f for f in plain.schema.fields if f.name != "text"), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return plain.mapInArrow(_encode(ranks, pattern), schema).select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "ids")


def decode(docs: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``docs`` and ``decoded`` (bytes of the ids); a column of that name is replaced."""
    names = free_names(docs, ["decoded"])
    inner = {c: "ids" if c == ids_col else f"c{i}" for i, c in enumerate(names)}
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in inner.items()))
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType())])
    return plain.mapInArrow(_decode(ranks), schema).select(*(F.col(x).alias(c) for c, x in inner.items()), "decoded")
