"""Packs documents into fixed-length sequences along a space-filling curve.

A document's vector is the sum of hashed words' random signs in a few
dimensions, scaled to unit length; the cell of the vector on a grid has a place
on the Hilbert curve. Rows are range-partitioned and sorted by that place, so
neighbours on the curve, which share words, end up in the same sequences. Each
partition cuts its stream of tokens every ``length`` tokens; only the last
sequence of a partition is padded.

The id follows the curve place in the sort, so many equal texts (one place) are
split over partitions as well.

Defined results: null text is empty and gives its end token only; repeated rows
are packed each; ids may be null. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import words as W
from docquarry.llm.shared import free_names

CACHED_WORDS = 400_000


def project(part: W.Words, dims: int) -> np.ndarray:
    """Unit vectors of hashed words; the null vector for documents without words."""
    hashed = W.hashes(part)
    out = np.zeros((len(part.first) - 1, dims))
    docs = W.doc_of(part.first)
    for d in range(dims):
        signs = ((hashed >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out[:, d] = np.bincount(docs, signs, len(out))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of coordinates below 2 ** bits).

    The coordinates are turned into the transposed index by Gray-code steps
    from the highest bit down, whose bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _places(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.zeros(0, np.int64)]
            for part in W.slices(batch.column("text"), lower=True):
                cells = np.clip(((project(part, dims) + 1) * (1 << (bits - 1))).astype(np.int64), 0, (1 << bits) - 1)
                places.append(hilbert(cells, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(places), pa.int64())], names=[*batch.schema.names, "place"])

    return run


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*plain, *(b for b in range(256) if b not in plain)], [chr(b) for b in plain] + [chr(256 + i) for i in range(256 - len(plain))]))


class WordTokens:
    """Ids of a tokenizer that drops white space and ends words at other characters than letters.

    Each word is encoded once while it stays in a bounded cache. Words of Latin
    letters are one piece for the tokenizer, so its model encodes them directly;
    a full stop or comma after an ASCII letter is a piece of its own; all other
    words go through the whole tokenizer. Control strings inside a text, exactly
    as the vocabulary writes them, keep their one id and cut the text in two;
    with other capitals they are plain words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        # control strings are cut out of the text before words are folded
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.controls = {c: np.array([i], "<u4").tobytes() for c, i in added.items()}
        self.cut = re.compile(b"(" + b"|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + b")") if added else None
        self.known: dict[bytes, bytes] = {}

    def _learn(self, word: bytes) -> bytes:
        known = self.known.get(word)
        if known is not None:
            return known
        text = word.decode().lower()
        if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalpha():
            ids = self._learn(word[:-1]) + self._learn(word[-1:])
        elif text.isalpha() and max(text) < "\u0250":
            piece = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self.known[word] = ids
        return ids

    def encode(self, words: list[bytes]) -> bytes:
        """The ids of a text's words as little-endian 32-bit numbers."""
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > CACHED_WORDS:
            known = self.known = {}
        return b"".join([known.get(w) or self._learn(w) for w in words])

    def encode_text(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if not any(c in text for c in self.controls):
            return self.encode(text.lower().split())
        return b"".join([self.controls.get(part) or self.encode(part.lower().split()) for part in self.cut.split(text)])


def _pack(path: str, length: int, end_id: int, wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        end = np.array([end_id], "<u4").tobytes()
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows, starts, pieces, totals, sequences, offsets = [], [], [], [], [], []
            data, at = W.flat(batch.column("text"))
            for row in range(batch.num_rows):
                ids = tokens.encode_text(data[at[row] : at[row + 1]].tobytes()) + end
                total, low = len(ids) // 4, 0
                while low < total:
                    n = min(length - offset, total - low)
                    rows.append(row)
                    starts.append(low)
                    pieces.append(ids[4 * low : 4 * (low + n)])
                    totals.append(total)
                    sequences.append(sequence)
                    offsets.append(offset)
                    low += n
                    offset += n
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                if len(rows) >= 20_000 or row + 1 == batch.num_rows:
                    names = [c for c in batch.schema.names if c not in ("text", "place", "id")]
                    kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
                    added = {"start": starts, "length": [len(p) // 4 for p in pieces], "ids": pieces, "ids_crc32": [zlib.crc32(p) for p in pieces],
                             "doc_tokens": totals, "sequence_id": sequences, "offset": offsets}
                    kept += [pa.array(added[c], pa.binary() if c == "ids" else pa.int64()) for c in wanted]
                    yield pa.RecordBatch.from_arrays(kept, names=[*names, *wanted])
                    rows, starts, pieces, totals, sequences, offsets = [], [], [], [], [], []

    return run


ADDED = ["start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1,
         dims: int = 4, bits: int = 8, with_ids: bool = True) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, then ``start, length, ids (little-endian 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset``; columns of these names are replaced."""
    names = [c for c in free_names(docs, ADDED) if c != text_col]
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = plain.mapInArrow(_places(dims, bits), T.StructType([*plain.schema.fields, T.StructField("place", T.LongType())]))
    # equal places are split by id, and equal ids by the rest of the row
    along = ["place", "id", F.xxhash64("text")]
    ordered = placed.repartitionByRange(*along).sortWithinPartitions(*along)
    added = ADDED if with_ids else [c for c in ADDED if c != "ids"]
    kept = [f for f in plain.schema.fields if f.name in inner]
    fields = [T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in added]
    out = ordered.mapInArrow(_pack(tokenizer, length, end_id, added), T.StructType([*kept, *fields]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), *added)
