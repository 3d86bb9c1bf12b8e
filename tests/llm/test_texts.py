"""Substring dedup, near duplicates, packing, BPE: against plain Python and the tokenizer libraries."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docquarry.llm import words as W
from docquarry.llm.bpe import BytePairs, decode, encode, read_ranks
from docquarry.llm.components import components
from docquarry.llm.neardup import near_duplicates, signatures
from docquarry.llm.packing import WordTokens, hilbert, pack
from docquarry.llm.substring import dedup_substrings
from tests.llm.fixture import corpus, groups, keep_words, words

DOCS = corpus()
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(5)
    return df.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("ids"), F.lit(2).alias("place"), F.lit("y").alias("id"), F.lit(0).alias("Score")).cache()


def test_words_of_a_batch():
    import pyarrow as pa

    texts = [t for _, t in DOCS]
    got, whole = [], []
    for part in W.slices(pa.array(texts), size=500):
        for d in range(len(part.first) - 1):
            got.append([part.text[part.start[i] : part.end[i]].decode() for i in range(part.first[d], part.first[d + 1])])
        whole += W.hashes(part).tolist()
    assert got == [words(t) for t in texts]
    alike = {}
    for word, number in zip([w for x in got for w in x], whole):
        assert alike.setdefault(word, number) == number
    assert len(set(alike.values())) == len(alike)


@pytest.mark.parametrize("window, gram, run_rows", [(20, 3, 100_000), (20, 4, 3), (5, 2, 10)])
def test_substring_dedup(docs, window, gram, run_rows):
    rows = dedup_substrings(docs, window=window, gram=gram, run_rows=run_rows).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in rows} == keep_words(DOCS, window)
    assert rows[0].asDict().keys() >= {"text", "ids", "place", "id", "Score"} and len(rows) == len(DOCS)


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (None, text), (2, "z " + text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 9, r["n_removed"], r["n_words"]) for r in dedup_substrings(df).collect())
    assert got == [(1, 0, 30), (1, 0, 30), (1, 0, 31), (2, 30, 31), (9, 30, 30)]
    assert dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("of_id", [None, 7])
def test_substring_dedup_tells_rows_of_one_id_apart(spark, of_id):
    # 4,000 texts of no or one id, of 20 to 59 words; every fourth holds a passage of document 1 at its own place
    passage = " ".join(f"p{i}" for i in range(25))
    plain = [" ".join(f"r{d}w{i}" for i in range(20 + d % 40)) for d in range(4000)]
    rows = [(of_id, f"{t} {passage} end{d}" if d % 4 == 0 else t) for d, t in enumerate(plain)]
    df = spark.createDataFrame([(1, passage), *rows], "doc_id bigint, text string").repartition(4)
    got = {r["text"]: (r["kept_words"], r["n_removed"]) for r in dedup_substrings(df).collect()}
    want = {text: (f"{t} end{d}", 25) if d % 4 == 0 else (t, 0) for d, ((_, text), t) in enumerate(zip(rows, plain))}
    assert got == {passage: (passage, 0), **want}


def test_substring_dedup_ties_behind_an_earlier_window(spark):
    # rows without an id tie at the same place; each loses the passage, also where its windows are shuffled one by one
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"{passage} tail{d}") for d in range(50)] + [(1, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(17)
    got = {r["kept_words"]: r["n_removed"] for r in dedup_substrings(df, run_rows=3).collect()}
    assert got == {passage: 0, **{f"tail{d}": 25 for d in range(50)}}


@pytest.mark.parametrize("shingle, neighbours", [(4, 3), (5, 1)])
def test_near_duplicates(docs, shingle, neighbours):
    rows = near_duplicates(docs, shingle=shingle, neighbours=neighbours).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == groups(DOCS, shingle, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (5, "A b C d e"), (None, "a b c d e"), (6, None), (7, "")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (6, 6, True), (7, 7, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(5)
    one = rnd.integers(0, 1 << 62, 400).astype(np.uint64)
    two = np.concatenate([one[:300], rnd.integers(0, 1 << 62, 100).astype(np.uint64)])
    few = [one[:3], one[:4], one[:1]]
    best = signatures([one, two, *few], 128)
    assert abs((best[0] == best[1]).mean() - 0.6) < 0.15 and (best[2] == best[3]).mean() > 0.5
    # a slot holds the least offer of any element, whatever the order of levels
    for s, row in zip([one, *few], best[[0, 2, 3, 4]]):
        assert (signatures([s], 128, lazy_levels=0)[0] == row).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100, 200: 150, 150: 150}


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    texts = [(i, t) for i, t in DOCS] + [(1, "it's 'quoted'  12,345\n\n\tx"), (2, "🙂" * 40), (3, " " * 500 + "a" * 700)]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("decoded", F.lit(1))
    rows = decode(encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert {r["doc_id"]: (r["ids"], bytes(r["decoded"]).decode()) for r in rows} == {i: (own.encode_ordinary(t or ""), t or "") for i, t in texts}
    assert encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_piece_is_linear():
    pairs = BytePairs(read_ranks(RANKS))
    assert sum(len(pairs.tokens[i]) for i in pairs.encode_piece("ab" * 40_000)) == 80_000


def test_packing(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    controls = [(901, "one <|endoftext|> two<|startoftext|>Three <|ENDOFTEXT|>"), (902, "<|endoftext|><|endoftext|>"), (903, "<|endoftext |>")]
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*DOCS, *controls]}
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(controls, docs.select("doc_id", "text").schema))
    rows = pack(more, WORDS, length=64).collect()
    pieces, filled = {}, {}
    for r in rows:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(own) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], own))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], len(own)))
    assert {i: [t for _, p in sorted(x) for t in p] for i, x in pieces.items()} == ids
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 64
    assert sum(sum(n for _, n in p) == 64 for p in filled.values()) >= len(filled) - 8
    assert pack(docs.limit(0), WORDS).count() == 0


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    tokens, lib = WordTokens(WORDS), Tokenizer.from_file(WORDS)
    for text in ["a<|endoftext|>B <|EndOfText|> <|endoftext|", "é<|startoftext|>\u0301x", "İstanbul ŉ ß ÀÉ a.b, c... d.,e é. 's it's l'été ́b, <|endoftext|>. Ａ ﬁ ſ K 12,345. ab12.", "Don't STOP, now."]:
        assert np.frombuffer(tokens.encode_text(text.encode()), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_hilbert_steps_to_neighbours():
    cells = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    place = hilbert(cells, 3)
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()
