"""Toxicity of documents by multiple-instance learning over sentences.

Labels are known for documents, not for sentences. Each sentence gets
p_s = sigmoid(bias + sum of its words' and word stems' weights); a document is toxic if any
sentence is: P = 1 - prod(1 - p_s), the noisy-or. Weights are fitted to the
document labels by gradient descent on the likelihood of P, so they learn
which sentences carry the label; those with p_s of 0.5 or more are named.

The model is fitted in one task on about ``max_docs`` labelled rows, drawn by a
hash of the id; its size is fixed (``2 ** bits`` weights). Every document is
scored on its whole text, row by row, without a shuffle.

Defined results: null and empty texts have no sentence and score 0; without
labelled rows all weights are 0 and every sentence has the prior; a label row
without a document, or a null label, teaches nothing; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import words as W
from docquarry.llm.shared import free_names

PRIOR = -6.0


@dataclass(frozen=True)
class Model:
    bits: int
    bias: float
    weights: np.ndarray


STEMS = (4, 5, 6)


def features(part: W.Words, bits: int) -> np.ndarray:
    """Per word its number and those of its first bytes (``STEMS``), so that all forms of a stem share a weight; a row per word."""
    shift = np.uint64(64 - bits)
    return np.stack([W.hashes(part) >> shift, *(W.hashes(part, n) >> shift for n in STEMS)], axis=1).astype(np.int64)


def _instances(bits: int):
    """Labelled texts as feature numbers (``1 + len(STEMS)`` for each word) and, per word, the number of its sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sentence in W.sentence_words(batch.column("text")):
                width = 1 + len(STEMS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(part.sizes), pa.int32()), batch.column("label")[part.rows].cast(pa.int32()),
                     pa.ListArray.from_arrays(pa.array(part.first * width, pa.int32()), pa.array(features(part, bits).reshape(-1).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(part.first, pa.int32()), pa.array(sentence.astype(np.int32)))], names=["model", "label", "words", "sentences"])

    return run


def fit(label: np.ndarray, doc: np.ndarray, sentence: np.ndarray, words: np.ndarray, size: int, steps: int = 150, rate: float = 0.15,
        shrink: float = 2e-4, min_docs: int = 3, min_z: float = 4.0) -> tuple[float, np.ndarray]:
    """Bias and weights that make the noisy-or of sentences likely, by Adam over all rows.

    ``doc`` and ``sentence`` say for each word where it stands, both numbered from 0; ``words`` has a column for each feature of a word.
    Only features take part whose documents' labels differ from the mean by ``min_z`` standard errors; rare words would be learned by heart.
    """
    docs, hits = np.zeros(size), np.zeros(size)
    for column in words.T:  # one at a time, for memory
        seen = np.unique(doc.astype(np.int64) * size + column)
        docs += np.bincount(seen % size, minlength=size)
        hits += np.bincount(seen % size, label[seen // size], size)
    mean = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    z = (hits - mean * docs) / np.sqrt(np.maximum(docs, 1) * mean * (1 - mean))
    good = (docs >= min_docs) & (np.abs(z) >= min_z)
    n_sentences = int(sentence.max(initial=-1)) + 1
    doc_of = np.zeros(n_sentences, np.int64)
    doc_of[sentence] = doc
    at, which = np.nonzero(good[words])
    word, sentence = words[at, which].astype(np.int64), sentence[at]
    used, word = np.unique(word, return_inverse=True)
    weights, bias = np.zeros(len(used)), PRIOR
    moment, spread = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights[word], n_sentences)
        soft = np.logaddexp(0, z)
        clean = np.exp(-np.minimum(np.bincount(doc_of, soft, len(label)), 700))
        share = np.where(label > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        slope = share[doc_of] * np.exp(z - soft)
        gradient = np.empty(len(used) + 1)
        gradient[:-1] = np.bincount(word, slope[sentence], len(used)) / len(label) + shrink * weights
        gradient[-1] = slope.sum() / len(label)
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6)
        weights -= move[:-1]
        bias -= move[-1]
    out = np.zeros(size)
    out[used] = weights
    return float(bias), out


def _fit(bits: int):
    def run(key, table):
        words, sentences = table.column("words").combine_chunks(), table.column("sentences").combine_chunks()
        own = sentences.flatten().to_numpy()
        doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(sentences.offsets.to_numpy()))
        opens = np.zeros(len(own), np.int32)
        opens[1:] = (np.diff(own) != 0) | (np.diff(doc) != 0)
        columns = words.flatten().to_numpy().reshape(len(own), 1 + len(STEMS))
        bias, weights = fit(table.column("label").to_numpy(), doc, np.cumsum(opens, dtype=np.int32), columns, 1 << bits)
        return pa.table({"bias": pa.array([bias], pa.float64()), "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_docs: int = 8_000, bits: int = 18) -> Model:
    """Fits a model to about ``max_docs`` of the rows in ``labels`` (id, 0/1) and their texts in ``docs``."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    total = known.count()
    if total > max_docs:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) < int(1_000_000 * max_docs / total))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    drawn = texts.join(F.broadcast(known), "id").select("text", "label")  # about max_docs rows
    rows = drawn.mapInArrow(_instances(bits), "model int, label int, words array<int>, sentences array<int>")
    row = rows.groupBy("model").applyInArrow(_fit(bits), "bias double, weights binary").first()
    if row is None:
        return Model(bits, PRIOR, np.zeros(1 << bits, np.float32))
    return Model(bits, row["bias"], np.frombuffer(row["weights"], "<f4"))


def sentence_scores(part: W.Words, sentence: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where sentences open (word numbers), the document of each, and softplus(z) of each."""
    if not len(sentence):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    opens = np.flatnonzero(np.diff(sentence, prepend=-1))
    z = model.bias + np.add.reduceat(model.weights[features(part, model.bits)].sum(axis=1, dtype=np.float64), opens)
    return opens, np.searchsorted(part.first, opens, "right") - 1, np.logaddexp(0, z)


SENTENCES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            scores, found, (data, at) = [np.zeros(0)], [], W.flat(batch.column("text"))
            for part, sentence in W.sentence_words(batch.column("text")):
                opens, docs, soft = sentence_scores(part, sentence, model)
                n = len(part.first) - 1
                scores.append(-np.expm1(-np.bincount(docs, soft, n)))
                named: list[list] = [[] for _ in range(n)]
                closes = np.append(opens[1:], len(part.start))
                for i in np.flatnonzero(-np.expm1(-soft) >= threshold).tolist():
                    low, high = part.start[opens[i]], part.end[closes[i] - 1]
                    base = at[part.rows.start]
                    named[int(docs[i])].append({"text": data[base + low : base + high].tobytes().decode("utf-8", "replace"), "score": float(-np.expm1(-soft[i]))})
                found += named
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(scores)), pa.array(found, kind)],
                                             names=[*names, "score", "sentences"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only with ``keep_text``), ``score``, ``predicted`` (1 from ``threshold`` on) and the offending
    ``sentences`` (text, score); columns of these names are replaced."""
    added = ["score", "predicted", "sentences"]
    names = [c for c in free_names(docs, added) if keep_text or c != text_col]
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [f for f in plain.schema.fields if f.name != "text"]
    scored = plain.mapInArrow(_score(model, threshold), T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("sentences", SENTENCES)]))
    return scored.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
