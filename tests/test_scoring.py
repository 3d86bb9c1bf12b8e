"""Best-k scoring against brute force, on every path."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import scoring
from docquarry.operators.keyword import containment_pairs, coverage_terms, keyword_coverage, keyword_idf, keyword_idf_topk, keyword_topk, keyword_topk_many
from docquarry.operators.buckets import Hashing, fit_hashing, semantic_topk_buckets, write_buckets
from docquarry.operators.semantic import recall_of, semantic_top1, semantic_topk, valid_vectors
from docquarry.operators.postings import read_postings, word_hits, write_postings
from docquarry.plans import retrieve

WORDS = "alpha beta gamma delta omega sigma kappa lambda mu nu xi pi rho tau phi chi".split()


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    chunks = []
    for i in range(300):
        v = base[i % 40] if i % 3 else base[0]          # a third of all rows share one vector
        text = " ".join(rng.choice(WORDS, 6)) if i % 3 else "alpha beta same text"
        chunks.append((i, f"local://c{i % 5}/doc-{i % 17}.md", f"Section {i}", text, [float(x) for x in v.astype(np.float32)], f"c{i % 5}"))
    questions = []
    for q in range(12):
        v = base[q] + 0.1 * rng.standard_normal(8)
        questions.append((q, "Find " + " ".join(rng.choice(WORDS, 3)), [float(x) for x in v.astype(np.float32)], 5,
                          f"c{q % 5}" if q % 4 == 0 else None))
    return chunks, questions


@pytest.fixture(scope="module")
def frames(spark, corpus):
    c = spark.createDataFrame(corpus[0], "id bigint, source string, location string, content string, embedding array<float>, category string")
    q = spark.createDataFrame(corpus[1], "query_id bigint, query string, query_vec array<float>, top_k int, category string")
    return q.repartition(2), c.repartition(5)


def brute(score, corpus, k, scoped=False):
    out = []
    for q in corpus[1]:
        rows = [(score(q, c), c[0]) for c in corpus[0] if not (scoped and q[4] and q[4] != c[5])]
        rows.sort(key=lambda r: (-r[0], r[1]))
        out += [(q[0], i, n + 1) for n, (s, i) in enumerate(rows[:k])]
    return sorted(out)


def cos(q, c):
    a, b = np.array(q[2], float), np.array(c[4], float)
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0


def coverage(q, c):
    words = [w for w in q[1].lower().split() if w != "find"]
    terms = ["find"] + words
    return sum(t in c[3].lower() for t in terms) / len(terms)


def ranks(df):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("max_block", [4096, 5, 2])
def test_semantic_paths_agree(frames, corpus, max_block):
    assert ranks(semantic_topk(*frames, 7, max_block=max_block)) == brute(cos, corpus, 7)


@pytest.mark.parametrize("max_block", [4096, 5])
def test_keyword_paths_agree(frames, corpus, max_block):
    assert ranks(keyword_topk(*frames, 9, max_block=max_block)) == brute(coverage, corpus, 9)


@pytest.mark.parametrize("max_block", [4096, 3])
def test_scope(frames, corpus, max_block):
    assert ranks(semantic_topk(*frames, 4, scope="category", max_block=max_block)) == brute(cos, corpus, 4, True)


@pytest.mark.parametrize("sample", [0, 0.3, 1.0])
@pytest.mark.parametrize("max_block", [4096, 5])
def test_floors_change_nothing(frames, corpus, sample, max_block):
    assert ranks(semantic_topk(*frames, 7, sample=sample, max_block=max_block)) == brute(cos, corpus, 7)
    assert ranks(keyword_topk(*frames, 7, sample=sample, max_block=max_block)) == brute(coverage, corpus, 7)


def test_floors_keep_partial_lists_short_whatever_the_splits(frames):
    q, c = frames
    rankings = [scoring.Ranking("best", scoring.VectorBlock, 7)]
    qv = q.select("query_id", F.col("query_vec").cast("array<double>"))
    seeded = scoring.best_of(scoring.partial_lists(rankings, qv, c.select("id", "embedding").sample(0.5, seed=1)), rankings)
    with_floors = qv.join(scoring.floors_of(rankings, seeded), "query_id", "left")
    sizes = [scoring.partial_lists(rankings, x, c.select("id", "embedding").repartition(n)).count() for x in (qv, with_floors) for n in (2, 30)]
    assert sizes[1] > 5 * sizes[0] and sizes[3] < sizes[1] / 3


@pytest.mark.parametrize("max_block", [4096, 5])
def test_two_lists_of_one_pass(frames, corpus, max_block):
    q, c = frames
    asked = retrieve.asked_lists(q, coverage_terms(q, []))
    semantic, keyword = retrieve.both_lists(asked, c, 9, max_block=max_block)
    assert ranks(semantic) == brute(cos, corpus, 9) and ranks(keyword) == brute(coverage, corpus, 9)


def test_one_pass_where_parts_are_missing(spark):
    q = spark.createDataFrame([("a", "alpha", None), ("b", "what is the", [1.0, 0.0]), ("c", "beta", [0.0, 0.0])], "query_id string, query string, query_vec array<float>")
    c = spark.createDataFrame([("x", "s", "alpha beta", [1.0, 0.0]), ("y", "s", "beta", None), ("z", "s", None, [0.0, 0.0])], "id string, source string, content string, embedding array<float>")
    asked = retrieve.asked_lists(q, coverage_terms(q, ["what", "is", "the"]))
    semantic, keyword = retrieve.both_lists(asked, c, 2)
    assert ranks(semantic) == [("b", "x", 1)]
    assert ranks(keyword) == [("a", "x", 1), ("a", "y", 2), ("c", "x", 1), ("c", "y", 2)]


@pytest.mark.parametrize("max_block", [4096, 5])
def test_string_ids(frames, corpus, max_block):
    """Ids of letters, of unequal lengths, in the order of their code points."""
    q, c = frames
    name = F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.when(F.col("id") % 2 == 0, "é").otherwise(""))
    c, q = c.withColumn("id", name), q.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    want = [(f"q{a}", f"{i:04d}" + ("é" if i % 2 == 0 else ""), n) for a, i, n in brute(cos, corpus, 7)]
    assert ranks(semantic_topk(q, c, 7, max_block=max_block)) == sorted(want)
    hybrid = retrieve.hybrid_retrieve(q, c.withColumn("source_type", F.lit("document")), floor=-1.0, max_block=max_block)
    assert {r["query_id"] for r in hybrid.collect()} == {f"q{i}" for i in range(12)}


def test_principals_see_what_they_are_granted(frames, corpus):
    q, c = frames
    q = q.withColumn("principals", F.when(F.col("query_id") > 0, F.array(F.lit("*"), F.concat(F.lit("u:"), F.col("query_id") % 3))))
    c = c.withColumn("grants", F.when(F.col("id") % 4 == 0, F.array(F.lit("*"))).when(F.col("id") % 4 == 1, F.array(F.concat(F.lit("u:"), F.col("id") % 3), F.lit("g:x"))))
    got = ranks(semantic_topk(q, c, 7))
    want = []
    for a in corpus[1][1:]:
        rows = sorted((-cos(a, b), b[0]) for b in corpus[0] if b[0] % 4 == 0 or b[0] % 4 == 1 and b[0] % 3 == a[0] % 3)
        want += [(a[0], i, n + 1) for n, (_, i) in enumerate(rows[:7])]
    assert got == sorted(want)
    fused = retrieve.fused_candidates(q, c.withColumn("source_type", F.lit("document")))
    assert fused.filter("id % 4 > 1 OR (id % 4 = 1 AND id % 3 <> query_id % 3) OR query_id = 0").count() == 0 < fused.count()


def test_fewer_chunks_than_k(frames):
    q, c = frames
    few = c.filter("id < 3")
    assert semantic_topk(q, few, 60).count() == 12 * 3
    assert keyword_topk(q, few, 60).count() == 12 * 3


def test_no_questions(frames):
    q, c = frames
    assert semantic_topk(q.filter("false"), c, 5).count() == 0
    assert keyword_topk(q.filter("false"), c, 5).count() == 0


def test_questions_without_keywords_have_no_list(spark, frames):
    q = spark.createDataFrame([(1, "what is the"), (2, "alpha")], "query_id bigint, query string")
    assert {r["query_id"] for r in keyword_topk(q, frames[1], 3).collect()} == {2}


def test_zero_and_missing_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0])], "id bigint, embedding array<float>")
    assert [r["id"] for r in valid_vectors(df).collect()] == [4]


def test_top1(frames, corpus):
    got = sorted((r["query_id"], r["id"]) for r in semantic_top1(*frames).collect())
    assert got == [(q, i) for q, i, _ in brute(cos, corpus, 1)]


def test_buckets_find_close_matches_and_score_exactly(spark, frames, corpus, tmp_dir):
    q, c = frames
    hashing = Hashing(slots=8)
    model = fit_hashing(spark, 8, hashing)
    write_buckets(c.filter("id < 100").select("id", "embedding"), f"{tmp_dir}/b", model)
    write_buckets(c.filter("id >= 100").select("id", "embedding"), f"{tmp_dir}/b", model)
    found = semantic_topk_buckets(q, spark.read.parquet(f"{tmp_dir}/b"), model, 10)
    close = semantic_topk(*frames, 10).filter("score > 0.9")
    assert recall_of(found, close).agg(F.avg("recall")).first()[0] > 0.9
    by_pair = {(a[0], b[0]): cos(a, b) for a in corpus[1] for b in corpus[0]}
    rows = found.collect()
    assert all(abs(by_pair[r["query_id"], r["id"]] - r["score"]) < 2e-6 for r in rows)
    assert len({(r["query_id"], r["id"]) for r in rows}) == len(rows)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    by_shuffle = semantic_topk_buckets(q, spark.read.parquet(f"{tmp_dir}/b"), model, 10, max_block=3)
    assert sorted(map(tuple, by_shuffle.collect())) == sorted(map(tuple, rows))


def test_document_frequency(spark, frames, corpus, tmp_dir):
    q, c = frames
    q = q.unionByName(q.limit(1).withColumn("query", F.lit("a bet lph x_y 日本 doc-1 5")))
    c = c.withColumn("content", F.when(F.col("id") == 7, "x_y,日本語 é").when(F.col("id") == 8, None).otherwise(F.col("content")))
    write_postings(c.filter("id < 100"), tmp_dir + "/p")
    write_postings(c.filter("id >= 100"), tmp_dir + "/p")
    texts = [((r["content"] or "").lower(), r["source"].lower()) for r in c.collect()]
    for index in (None, read_postings(spark, tmp_dir + "/p")):
        got = {r["word"]: (r["df"], r["n"]) for r in keyword_idf(q, c, [], index=index).collect()}
        assert {"bet", "lph", "x_y", "日本", "5", "find"} <= set(got)
        for word, (df, n) in got.items():
            assert df == sum(word in text or word in name for text, name in texts) and n == 300


def test_coverage(spark, frames, corpus, tmp_dir):
    q, c = frames
    write_postings(c, tmp_dir + "/p")
    want = {}
    for a in corpus[1]:
        scores = [coverage(a, b) for b in corpus[0]]
        want[a[0]] = (sum(s > 0 for s in scores), round(max(scores), 6), pytest.approx(sum(scores) / 300, abs=2e-6))
    for index in (None, read_postings(spark, tmp_dir + "/p")):
        assert {r["query_id"]: (r["n_hit"], r["max_score"], r["avg_score"]) for r in keyword_coverage(q, c, [], index=index).collect()} == want


def test_stored_postings_are_pruned_by_slot(spark, frames, tmp_dir):
    write_postings(frames[1], tmp_dir + "/p")
    words = spark.createDataFrame([("alpha",), ("gam",), ("doc",)], "word string")
    hits = word_hits(words, read_postings(spark, tmp_dir + "/p"))
    assert {r["word"] for r in hits.select("word").distinct().collect()} == {"alpha", "gam", "doc"}
    assert "slot" in hits._jdf.queryExecution().executedPlan().toString()


def test_postings_cut_each_text_once_and_list_each_place_of_a_token_once(spark, tmp_dir):
    texts = [" ,a,,banana b ", "", None, "é_1 Banana", "\u0130stanbul \u039f\u0394\u039f\u03a3.\u0391 \u2167 日本"]
    cut = spark.sparkContext.accumulator(0)

    def seen(text):
        cut.add(1)
        return text

    plain = spark.createDataFrame([(i, t, f"x/{i}.md") for i, t in enumerate(texts)], "id bigint, content string, source string")
    plain.write.parquet(tmp_dir + "/c")
    c = spark.read.parquet(tmp_dir + "/c").withColumn("content", F.udf(seen)("content"))
    write_postings(c, tmp_dir + "/p")
    assert cut.value == len(texts)
    index = read_postings(spark, tmp_dir + "/p")
    want = plain.selectExpr("id", "false AS in_name", "explode(array_distinct(regexp_extract_all(lower(content), '([\\\\p{L}\\\\p{N}_]+)', 1))) AS token")
    assert sorted(map(tuple, index.tokens.filter("NOT in_name").select("id", "in_name", "token").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r["gram"] for r in index.grams.filter("token = 'banana'").collect()) == ["a", "ana", "ban", "na", "nan"]
    # a later batch lists its own tokens only, and a word found at several places counts once
    write_postings(plain.filter("id = 3"), tmp_dir + "/p")
    assert index.sizes.count() == 1 and read_postings(spark, tmp_dir + "/p").grams.filter("token = 'a'").count() == 1
    hits = word_hits(spark.createDataFrame([("a",), ("na",), ("anan",)], "word string"), index, names=False).collect()
    assert sorted(map(tuple, hits)) == [("a", 0), ("a", 3), ("a", 4), ("anan", 0), ("anan", 3), ("na", 0), ("na", 3)]


def test_prefix_match_on_source_names(spark):
    c = spark.createDataFrame([(1, "x/billing-2024.md", "nothing here"), (2, "x/other.md", "nothing here")],
                              "id bigint, source string, content string")
    q = spark.createDataFrame([(1, "bill"), (2, "billings"), (3, "zzz")], "query_id bigint, query string")
    got = {(r["query_id"], r["id"]) for r in keyword_idf_topk(q, c, 5).collect()}
    assert got == {(1, 1), (2, 1)}


def test_containment_with_equal_phrases(spark):
    p = spark.createDataFrame([(1, "b c"), (2, "b c"), (3, "B C")], "query_id bigint, phrase string")
    t = spark.createDataFrame([(7, "a b c d"), (8, "none")], "id bigint, text string")
    assert sorted(map(tuple, containment_pairs(p, t).collect())) == [(1, 7), (2, 7)]


@pytest.mark.parametrize("flow", [retrieve.search_documents, retrieve.hybrid_retrieve, retrieve.legacy_retrieve])
def test_retrieval_with_many_questions_joins_by_shuffle(frames, flow):
    q, c = frames
    c = c.withColumn("source_type", F.lit("document"))
    assert sorted(map(tuple, flow(q, c).collect())) == sorted(map(tuple, flow(q, c, max_block=4).collect()))


def test_search_of_many_questions_sends_no_texts_to_the_grid(spark, frames, monkeypatch):
    """Beyond a block, texts are walked once, for all words, and candidates carry no texts; the rows stay the same."""
    q, c = frames
    c = c.withColumn("source_type", F.lit("document"))
    want = sorted(map(tuple, retrieve.search_documents(q, c, floor=-1.0).collect()))
    sent = []
    real = scoring.meet
    monkeypatch.setattr(scoring, "meet", lambda fold, asked, chunks, *a, **b: sent.append((b.get("key"), {*chunks.columns})) or real(fold, asked, chunks, *a, **b))
    got = retrieve.search_documents(q, c, floor=-1.0, max_block=4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert [k for k, columns in sent if "text" in columns] == ["word"]


@pytest.mark.parametrize("common", [0, 40, 10_000])
def test_keyword_lists_of_many_questions_by_rare_and_common_words(spark, frames, corpus, common):
    q, c = frames
    for scope in (None, "category"):
        terms = coverage_terms(q, [], scope)
        texts = c.select("id", F.lower("content").alias("text"), *scoring.scoped(c, scope))
        got = keyword_topk_many(terms, texts, 9, common=common, max_block=4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keyword_topk(q, c, 9, stopwords=[], scope=scope).collect()))


def test_best_pairs_are_the_same_whenever_lists_are_cut():
    rng = np.random.default_rng(5)
    q, s, i = rng.integers(0, 7, 4000), np.round(rng.random(4000), 2), rng.permutation(4000)
    s[q == 3] = 0.5  # nothing but ties
    want = sorted((int(a), -float(b), int(c)) for a, b, c in zip(q, s, i))
    want = [w for n in range(7) for w in [x for x in want if x[0] == n][:5]]
    for step in (1, 37, 4000):
        best = scoring.BestK(8, 5)
        for at in range(0, 4000, step):
            best.add_pairs(q[at:at + step], s[at:at + step], i[at:at + step])
        best.cut()
        assert sorted(zip(best.q.tolist(), (-best.s).tolist(), best.i.tolist())) == want


def test_guard_drops_weak_questions(spark):
    from docquarry.operators.fusion import similarity_guard

    df = spark.createDataFrame([(1, 0.39), (1, 0.2), (2, 0.40), (2, 0.1)], "query_id bigint, semantic_score double")
    assert sorted(map(tuple, similarity_guard(df).collect())) == [(2, 0.1), (2, 0.4)]


def test_model_scorer_seam(frames):
    from docquarry.functions.seams import pair_scorer

    q, c = frames
    c = c.withColumn("source_type", F.lit("document"))
    scorer = pair_scorer(lambda: (lambda qs, cs: [float(len(x)) for x in cs]))
    top = retrieve.hybrid_retrieve(q, c, scorer=scorer, floor=-1.0).filter("rank = 1").collect()
    assert top and all(r["score"] >= len(r["content"]) for r in top)


def test_keyword_lists_scan_without_postings(spark, frames, monkeypatch):
    """Rarity, coverage and lists come from passes over the texts: no word meets the chunks row by row."""
    from docquarry.operators import keyword

    for name in ("weighted_hits", "word_df"):
        monkeypatch.setattr(keyword, name, None)
    q, c = frames
    for found in (keyword_idf(q, c, []), keyword_coverage(q, c, []), keyword_idf_topk(q, c, 5)):
        assert found.count()


def test_stored_lists_take_texts_in_small_batches_whatever_the_partitions(spark):
    from docquarry.session import BATCH_ROWS

    class Held:
        """Scores each chunk by the chunks that came with it."""

        needs = ("terms",)

        def __init__(self, questions):
            self.n = len(questions)

        def scores(self, batch):
            return np.full((self.n, batch.num_rows), float(batch.num_rows))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    q = spark.createDataFrame([(1, ["a"])], "query_id bigint, terms array<string>")
    for rows in (3 * BATCH_ROWS, 9 * BATCH_ROWS):
        c = spark.range(rows).coalesce(1).withColumn("text", F.lit("a"))
        found = scoring.stored_lists([scoring.Ranking("held", Held, rows)], q, c, sample=0)
        assert found.agg(F.max("score"), F.count("*")).first() == (BATCH_ROWS, rows)
    assert spark.conf.get(key) == before


def test_both_lists_read_the_chunks_once(spark, frames):
    from docquarry.plans.retrieve import asked_lists, both_lists

    q, c = frames
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    c = c.mapInArrow(seen, c.schema)
    semantic, keyword = both_lists(asked_lists(q, coverage_terms(q, [])), c, 5, sample=0)
    assert fusion_rows(semantic, keyword) and passes.value == 300


def fusion_rows(semantic, keyword) -> int:
    from docquarry.operators.fusion import rrf_fusion

    return rrf_fusion(semantic, keyword).count()
