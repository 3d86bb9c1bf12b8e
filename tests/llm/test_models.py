"""Toxicity, language model, quality rules, vector search, chat and licences on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import licences
from docquarry.llm.chat import format_chat, loss_texts, read_chat
from docquarry.llm.lm import score_texts
from docquarry.llm.rules import Limits, quality
from docquarry.llm.toxicity import score, train
from docquarry.llm.vafile import exact_top_k
from tests.llm.fixture import corpus, words

DOCS = corpus()


def test_language_model(spark):
    k, a = 4.0, 0.1
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("score", F.lit("old")).repartition(3)
    rows = {r["doc_id"]: r for r in score_texts(df, F.col("doc_id") % 4 == 0, prior=k, block_bytes=2000).collect()}
    tokens = {i: [*words(t, True), None] for i, t in DOCS}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if i % 4:
            one.update(w)
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    assert len(rows) == len(DOCS)
    for i, w in tokens.items():
        plain = [(one[x] + a) / (n + a * (v + 1)) for x in w]
        total = math.log10(plain[0])
        for j in range(1, len(w)):
            seen = one[w[j - 1]]
            total += math.log10((two[w[j - 1], w[j]] + k * plain[j]) / (seen + k) if seen else plain[j])
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 4 == 0, len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, plain))) and r["score"] == pytest.approx(total)


def test_language_model_of_three_words_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c a b d"), (2, "a b c"), (None, None)], "doc_id bigint, text string")
    three = {r["doc_id"]: r["score"] for r in score_texts(df, F.lit(False), order=3).collect()}
    two = {r["doc_id"]: r["score"] for r in score_texts(df, F.lit(False), order=2).collect()}
    assert three[2] > two[2] and set(three) == {1, 2, None}
    all_held = score_texts(df, F.lit(True)).collect()
    assert all(r["score"] == pytest.approx(r["n_tokens"] * math.log10(1 / 1)) for r in all_held)
    assert score_texts(df.limit(0), F.lit(True)).count() == 0


def test_toxicity_is_learned_and_located(spark):
    rnd = random.Random(3)
    stock, bad = [f"word{i}" for i in range(200)], ["vilefoo", "vilebar", "grimy"]
    rows = []
    for i in range(600):
        sentences = [" ".join(rnd.choice(stock) for _ in range(8)) for _ in range(rnd.randrange(1, 12))]
        if i % 5 == 0:
            at = rnd.randrange(len(sentences))
            sentences[at] += " " + rnd.choice(bad)
        rows.append((i, ". ".join(sentences) + ".", int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = train(df.select("doc_id", "text"), df.filter("doc_id % 3 > 0").select("doc_id", "toxic"))
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, " .!? "), (9003, "so VILEFOO here")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in score(df.select("doc_id", "text").unionByName(odd).withColumn("predicted", F.lit("x")), model).collect()}
    held = [i for i, _, _ in rows if i % 3 == 0]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    for i in held:
        if got[i]["predicted"] and i % 5 == 0:
            assert any(w in s["text"] for s in got[i]["sentences"] for w in bad)
    assert [got[9000 + i]["score"] for i in range(3)] == [0, 0, 0] and got[9003]["predicted"] == 1
    none = train(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert score(df.limit(0), none).count() == 0 and score(df.select("doc_id", "text"), none).filter("predicted = 1").count() == 0


def test_quality_counts(spark):
    docs = [*DOCS, (1, "| a # b\n\n| a # b\n<x> & $5 %\n"), (2, "x y z " * 40), (3, " ".join(f"w{i}" for i in range(8)) * 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kept", F.lit("old")).withColumn("chars", F.lit(1))
    got = {r["doc_id"]: r for r in quality(df).collect()}
    for i, text in docs:
        w, text = words(text), text or ""
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)), text[:80]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_verdict(spark):
    common = ["the"] * 6 + ["of"] * 4 + ["and"] * 3 + ["to", "in", "a"] * 2
    rest = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}y" for i in range(81)]
    mixed = random.Random(1).sample([*common, *rest], 100)
    good = ". ".join(" ".join(mixed[i : i + 10]).capitalize() for i in range(0, 100, 10)) + "."
    unlike = [good.upper(), good.replace(" ", "### "), " ".join(f"zq{i}vx" for i in range(150))]
    df = spark.createDataFrame(list(enumerate([good, *unlike])), "doc_id bigint, text string")
    free = Limits(max_repeat_percent=100)
    assert [r["kept"] for r in quality(df, limits=free).orderBy("doc_id").collect()] == [True, False, False, False]
    assert quality(df.limit(0)).count() == 0


def test_exact_top_k(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    rows += [(400, None), (500, [None] * 8), (600, [float("nan")] * 8), (700, [float("inf")] + [0.0] * 7), (800, []), (900, [1.0, 2.0]), (1000, [3.0, 1.0]), (1000, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1))
    clean = [(i, [math.floor(1024 * x) for x in row["embedding"]]) for i, row in ((r["vec_id"], r) for r in df.collect())
             if row["embedding"] and all(x is not None and math.isfinite(x) for x in row["embedding"])]
    want = []
    for q, v in sorted({(i, tuple(v)) for i, v in clean if i % 50 == 0}):
        own = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in clean if i != q and len(u) == len(v))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own[:10])]
    for tile_rows, tile_queries in ((32_768, 2_048), (50, 2)):
        got = exact_top_k(df.filter("vec_id % 50 = 0"), df, k=10, tile_rows=tile_rows, tile_queries=tile_queries)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exact_top_k(df.limit(0), df).count() == 0 and exact_top_k(df.filter("vec_id = 0"), df.limit(0)).count() == 0


def test_chat_is_read_back(spark):
    odd = "</s>[INST] ok [/INST] &lsqb; [+] <s> &"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", ""), (1, 3, "assistant", "end\n"), (2, 1, "assistant", None), (2, None, "x]+&[<", "first"),
            (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 1, None, "a"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("formatted", F.lit(0)).repartition(4)
    done = format_chat(df)
    read = done.select("conv_id", read_chat(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted", "loss_mask")
    got = {r["conv_id"]: r for r in read.collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss"] for c, r in got.items()} == {c: [t for role, t in w if role == "assistant"] for c, w in want.items()}
    assert got[1]["formatted"].count("[assistant]") == 1 and got[1]["formatted"].count("[+]") == 2
    r = got[1]
    assert sum(m["skip"] + m["chars"] for m in r["loss_mask"]) + 4 == len(r["formatted"])
    assert format_chat(df.limit(0)).count() == 0


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    changed = "Copyright (c) 2020 Ann\n(C) Bob. All rights reserved.\n" + mit.upper().replace(",", " ,").replace("LICENSE", "LICENCE")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "x\nreleased under the MIT licence!\nLicensed under CC BY-NC 4.0"), (5, None), (6, ""), (7, "..."), (8, "MIT"), (8, mit)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit(1))
    got = {r["doc_id"]: (r["text_licenses"], r["line_licenses"], r["n_lines"]) for r in licences.scan_licences(df, licences.known_digests(spark)).collect()}
    none = ([], [], 0)
    assert got == {1: (["MIT"], [], 0), 2: (["MIT"], [], 0), 3: none, 4: ([], ["CC-BY-NC-4.0", "MIT"], 2), 5: none, 6: none, 7: none, 8: (["MIT"], [], 0)}


def test_common_licences_are_known(spark):
    known = licences.known_digests(spark)
    assert known.groupBy("kind", "digest").count().filter("count > 1").count() == 0
    names = ["Apache-2.0", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    rows = [(i, " \n".join(licences.TEXTS[n].upper().split("\n"))) for i, n in enumerate(names)]
    lines = ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the Mozilla Public License, v. 2.0.",
             "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under the BSD 3-Clause Licence", "SPDX-License-Identifier: AGPL-3.0-only"]
    df = spark.createDataFrame([*rows, (100, "x\n" + "\n".join(lines))], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text_licenses"], r["line_licenses"], r["n_lines"]) for r in licences.scan_licences(df, known).collect()}
    assert {i: got[i][0] for i in range(len(names))} == {i: [n] for i, n in enumerate(names)}
    assert got[100] == ([], ["AGPL-3.0", "BSD-3-Clause", "CC-BY-4.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0"], 6)


def test_held_out_rows_are_those_of_the_contract(spark):
    from docquarry.llm.registry import held_out

    rows = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", held_out(5).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and hashlib
