"""Sentence and claim checks on literal answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.operators import grounding as gr
from docquarry.plans import answer

CTX = "MRR (Q2 2025): INR 4.8 Crore. QoQ +22%. Anna Krishnan owns the plan."


@pytest.mark.parametrize("a, context, ok, bad", [
    ("I don't have that information.", CTX, True, []),
    ("MRR was 99 crore.", CTX, False, ["99"]),
    ("MRR was 4.8 Crore in Q2 2025.", CTX, True, []),
    ("MRR was 4.8 Crore.", " ", False, ["<no context>"]),
    ("Anna Krishnan owns it. [Source: local://x.md | Section 9]", CTX, True, [])])
def test_grounding_check(spark, a, context, ok, bad):
    row = gr.grounding_check(spark.createDataFrame([(a, context)], "answer string, context string")).first()
    assert (row["ok"], row["unsupported"]) == (ok, bad)


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([
        (1, 1, "local://policy/leave.md", "Section 1", "Staff get 24 days of leave in 2024. Ask Ms. Roy."),
        (1, 2, "local://policy/pay.md", "Section 2", "Salaries are paid on the 25th of every month."),
    ], "answer_id bigint, rank int, source string, location string, content string")


def ground(spark, evidence, text, **options):
    a = spark.createDataFrame([(1, text)], "answer_id bigint, answer string")
    row = gr.ground_answers(a, evidence, **options).first()
    return row["grounded"], [s["label"] for s in row["sentences"]]


@pytest.mark.parametrize("text, grounded, labels", [
    ("Staff get 24 days of leave [Citation: leave.md, Section 1].", "Staff get 24 days of leave [Citation: leave.md, Section 1].", ["cited"]),
    ("Staff get 24 days of leave [Citation: other.md, Section 1].", fixed.NOT_FOUND_ANSWER, ["bad_citation"]),
    ("Staff get 30 days of holiday in 2031.", fixed.NOT_FOUND_ANSWER, ["unsupported"]),
    ("Salaries are paid on the 25th of the month.",
     "Salaries are paid on the 25th of the month [Citation: local://policy/pay.md, Section 2].", ["auto_cited"]),
    ("Based on the context it rains. The [Job Title] is open for all.", "Based on the context it rains.", ["meta", "placeholder"]),
    ("I don’t know the exact number of days.", "I don’t know the exact number of days.", ["fallback"]),
    ("Yes it is so. Here is the whole list of days", "Yes it is so. Here is the whole list of days", ["short", "transition"]),
    ("", fixed.NOT_FOUND_ANSWER, [])])
def test_ground(spark, evidence, text, grounded, labels):
    assert ground(spark, evidence, text) == (grounded, labels)


def test_strict_option_drops_meta(spark, evidence):
    assert ground(spark, evidence, "Based on the context it rains.", strict_meta=True)[0] == fixed.NOT_FOUND_ANSWER


def test_answer_without_evidence(spark, evidence):
    a = spark.createDataFrame([(2, "Staff get 24 days of leave [Citation: leave.md, Section 1].")], "answer_id bigint, answer string")
    assert gr.ground_answers(a, evidence).first()["grounded"] == fixed.NOT_FOUND_ANSWER


def test_guarded_answers(spark, evidence):
    a = spark.createDataFrame([(1, "Paid on the 25th, said Bob Mann and 77 others."), (3, "I cannot find it.")], "answer_id bigint, answer string")
    got = {r["answer_id"]: (r["response"], r["trace"]) for r in gr.guarded_answers(a, evidence).collect()}
    assert got[1] == (fixed.STRICT_REFUSAL, ["Bob Mann", "77"]) and got[3] == ("I cannot find it.", None)


def test_sidecar(spark):
    e = spark.createDataFrame([
        (1, 1, "local://multimedia/board.png", "p", "seen"), (1, 2, "local://multimedia/board.md", "s", "noted"),
        (1, 3, "local://multimedia/other.png", "p", "kept"), (2, 1, "local://multimedia/board.png", "p", "alone"),
        (1, 4, "local://docs/board.png", "p", "elsewhere")], "answer_id bigint, rank int, source string, location string, content string")
    assert {r["content"] for r in gr.sidecar_evidence(e).collect()} == {"noted", "kept", "alone", "elsewhere"}
    ctx = {r["answer_id"]: r["context"] for r in gr.evidence_context(e).collect()}
    assert ctx[2] == "local://multimedia/board.png | p | alone"


def test_final_answers(spark):
    q = spark.createDataFrame([(1, "When are salaries paid?"), (2, "Unknown things?"), (3, "Nothing found?")], "query_id bigint, query string")
    found = spark.createDataFrame([
        (1, 1, "pay.md", "Section 2", "Intro text. Salaries are paid on the 25th of every month.", 3.0),
        (2, 1, "pay.md", "Section 1", "Other words only.", 1.0)],
        "query_id bigint, rank int, source string, location string, content string, score double")
    raw = answer.extractive_answers(q, found)
    got = {r["query_id"]: r for r in answer.answer_questions(q, found, raw, "it@x.org").collect()}
    assert got[1]["response"].startswith("Salaries are paid on the 25th of every month [Citation: pay.md, Section 2]")
    assert [tuple(c) for c in got[1]["citations"]] == [("pay.md", "Section 2")] and not got[1]["refused"]
    assert got[2]["refused"] and got[2]["response"].endswith("please contact it@x.org") and len(got[2]["retrieved"]) == 1
    assert got[3]["refused"] and got[3]["retrieved"] == []


def test_generator_seam(spark):
    from docquarry.functions.seams import generator

    packs = spark.createDataFrame([(1, "q", "c")], "query_id bigint, query string, context string")
    assert generator(packs, lambda: (lambda q, c: q + c)).first()["answer"] == "qc"


def test_golden(spark):
    from docquarry.operators.evaluation import golden_checks

    rows = [(1, "It is 4.8 crore [a-doc]", ["4.8"], ["a-doc"], ["48 crore"]), (2, "It is 48 crore", ["4.8"], ["a-doc"], ["48 Crore"]),
            (3, "I cannot find it", ["4.8"], ["a-doc"], ["48"])]
    df = spark.createDataFrame(rows, "answer_id int, answer string, must_contain_any array<string>, must_cite_any array<string>, must_not_contain array<string>")
    assert {r["answer_id"]: r["ok"] for r in golden_checks(df).collect()} == {1: True, 2: False, 3: True}


def test_longest_evidence_prefers_the_first(spark):
    df = spark.createDataFrame([(1, 1, "a", "xx"), (1, 2, "b", "yy"), (1, 3, "c", "z")], "answer_id int, seq int, tool string, content string")
    assert gr.longest_evidence(df).first()["tool"] == "a"


def test_result_count(spark):
    df = spark.createDataFrame([("list", 3, False, False), ("dict", 0, True, False), ("dict", 0, True, True), ("dict", 0, False, False)],
                               "k string, n int, e boolean, s boolean")
    got = [r[0] for r in df.select(gr.result_count(F.col("k"), F.col("n"), F.col("e"), F.col("s"))).collect()]
    assert got == [3, 0, 1, 1]


def test_answers_with_many_chunks_and_copies(spark):
    # every chunk of one answer holds one word of the sentence; together they back the citation, alone none does
    words = ["alpha", "bravo", "charlie", "delta"]
    rows = [(1, i + 1, "local://a/doc.md", f"Section {i}", f"filler {words[i % 4]} text") for i in range(1000)]
    rows += [(1, 2001, "other.md", "Section 1", "alpha bravo charlie delta"), (1, 2001, "other.md", "Section 1", "alpha bravo charlie delta")]
    e = spark.createDataFrame(rows, "answer_id bigint, rank int, source string, location string, content string")
    texts = ["Seen were alpha then bravo [Citation: doc.md, Section 1].", "Seen were alpha then bravo and charlie."]
    a = spark.createDataFrame([(1, "\n".join(texts)), (2, texts[1])], "answer_id bigint, answer string")
    got = {(r["answer_id"], r["pos"]): (r["label"], r["text"]) for r in gr.ground_sentences(a, e).collect()}
    assert got == {(1, 0): ("cited", texts[0]), (2, 0): ("unsupported", None),
                   (1, 1): ("auto_cited", "Seen were alpha then bravo and charlie [Citation: other.md, Section 1].")}
    assert {r["pos"]: r["n_supporting"] for r in gr.sentence_support(a, e).collect()} == {0: 2, 1: 2}
    assert gr.ground_sentences(a, e.limit(0)).filter("label = 'unsupported'").count() == 2 and gr.ground_sentences(a.limit(0), e).isEmpty()
    plan = gr.ground_sentences(a, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
