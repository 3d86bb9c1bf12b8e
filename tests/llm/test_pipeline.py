"""The pipeline's stages on a small corpus, and the SQL of the operators on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from docquarry.llm import registry
from docquarry.llm.shared import persist
from tests.llm.fixture import groups, keep_words, words
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = [r.asDict(recursive=True) for r in df.collect()]
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [[r[c] for c in df.columns] for r in got]) == rows_of(columns, cur.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        done = persist(stage(spark, docs, SF), "stage")
        if name == "packing":
            assert {r["doc_id"] for r in done.collect()} == {r["doc_id"] for r in before}
            break
        assert done.columns == columns
        after, texts = done.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "near duplicates":
            want = groups(texts, 5, 80)
            assert {r["doc_id"] for r in after} == {i for i, (_, head) in want.items() if i == head}
        elif name == "substring dedup":
            want = keep_words(texts, 20)
            assert {r["doc_id"]: words(r["text"]) for r in after} == {i: kept.split() for i, (_, _, kept) in want.items()}
            assert all(r["n_chars"] == len(r["text"] or "") for r in after)
        else:
            assert {r["doc_id"] for r in after} <= {i for i, _ in texts}
        docs, before = done, after
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(before) > 0.5 * len(labels)


def test_near_duplicates_of_rows_with_shared_or_null_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one, "x"), (1, two, "x"), (2, one + " end", "x"), (3, "", "x"), (4, "", "x"), (5, None, "x"),
            (None, three, "y"), (None, three, "z"), (None, three + " end", "y"), (None, two + " end", "y"), (6, one + " stop", "x"), (6, "its own few words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    third = [r for r in got if r[0] is None]
    want = [(1, one, "x"), (1, two, "x"), (3, "", "x"), (4, "", "x"), (5, None, "x"), (6, "its own few words here", "x")]
    assert sorted(set(got) - set(third), key=str) == sorted(want, key=str) and len(got) == len(want) + 1
    assert len(third) == 1 and third[0][1:] in ((three, "y"), (three + " end", "y"))
