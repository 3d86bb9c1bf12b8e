"""Evaluation of answers and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as tx


def gen_questions(documents: DataFrame, n: int = 30) -> DataFrame:
    """Questions with a known answer: documents that name a technique id.

    The ``n`` first documents by name; the first id in order is the target.
    """
    ids = documents.withColumn("tokens", tx.technique_ids(F.col("text"))).filter(F.size("tokens") > 0)
    human = tx.strip(F.replace(F.replace("name", F.lit("-"), F.lit(" ")), F.lit(".md"), F.lit("")))
    return ids.orderBy("name").limit(n).select(
        F.lit("HIT").alias("category"),
        F.concat(F.lit("Which MITRE technique does the '"), human, F.lit("' skill address?")).alias("q"),
        F.col("name").alias("expected_source"), F.get("tokens", F.lit(0)).alias("expected_token"), "tokens")


def _contains(hay: Column, needle: Column) -> Column:
    return F.contains(F.lower(F.coalesce(hay, F.lit(""))), F.lower(needle))


def cites(citations: Column, answer: Column, expected: Column) -> Column:
    """The expected source is among the parsed citations or the raw citation marks."""
    return F.exists(citations, lambda c: _contains(c["source"], expected)) | F.exists(
        tx.cited_names(answer), lambda c: _contains(c, expected))


def score_answers(answers: DataFrame) -> DataFrame:
    """``category, question, answer, citations, context, expected_sources`` to ``ok, retrieval_hit, reason``.

    HIT: refused or cited. REFUSE: refused. TRAP: refused or no unsupported
    specific. MERGE: all expected sources cited. A row with an ``error`` (where
    the column is there) failed, whatever it says.
    """
    a = F.coalesce("answer", F.lit(""))
    scored = (
        answers.withColumn("refused", tx.eval_refused(F.col("answer"), F.size("citations")))
        .withColumn("invented", tx.unsupported_specifics(a, F.col("context"), F.col("question")))
        .withColumn("n_cited", F.size(F.filter("expected_sources", lambda s: cites(F.col("citations"), a, s)))))
    marked = (F.size("citations") > 0) | a.rlike(r"(?i)\[Citation:")
    ok = (
        F.when(F.col("category") == "HIT", F.col("refused") | marked)
        .when(F.col("category") == "REFUSE", F.col("refused"))
        .when(F.col("category") == "TRAP", F.col("refused") | (F.size("invented") == 0))
        .otherwise(F.col("n_cited") == F.size("expected_sources")))
    reason = (
        F.when((F.col("category") != "MERGE") & F.col("refused"), "refused")
        .when(F.col("category") == "HIT", F.when(F.col("n_cited") > 0, "cited expected source").otherwise("cited other source"))
        .when(F.col("category") == "REFUSE", "answered")
        .when(F.col("category") == "TRAP", F.when(F.size("invented") > 0, "invented specifics").otherwise("supported"))
        .otherwise(F.concat(F.lit("cited "), F.col("n_cited"), F.lit("/"), F.size("expected_sources"))))
    if "error" in answers.columns:
        failed = F.col("error").isNotNull()
        ok, reason = ok & ~failed, F.when(failed, F.concat(F.lit("error: "), "error")).otherwise(reason)
    return scored.withColumn("ok", ok).withColumn("retrieval_hit", F.col("n_cited") > 0).withColumn("reason", reason)


def eval_rates(scored: DataFrame) -> DataFrame:
    """Passes and rates per category with a total line."""
    return scored.rollup("category").agg(
        F.count_if("ok").alias("passed"), F.count("*").alias("total"),
        F.round(100.0 * F.avg(F.col("ok").cast("int")), 4).alias("rate"),
        F.round(100.0 * F.avg(F.when(F.col("category") == "HIT", F.col("retrieval_hit").cast("int"))), 4).alias("hit_rate"),
    ).withColumn("category", F.coalesce("category", F.lit("total")))


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """Recall, precision, MRR, NDCG and hit rates, averaged over questions with labels.

    ``ranked``: ``by…, query_id, doc, rank`` (rank from 1); ``qrels``: ``by…,
    query_id, doc``. Question rows are folded to numbers in two aggregations;
    a document counts once per question, at its best rank.
    """
    key = [*by, "query_id"]
    found = ranked.groupBy(*key, "doc").agg(F.min("rank").alias("rank"))
    judged = qrels.select(*key, "doc").distinct().join(found, [*key, "doc"], "left")

    def at(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))

    per_query = judged.groupBy(*key).agg(
        F.count("*").alias("n_rel"), *[at(k).alias(f"h{k}") for k in (1, 3, 5, 10)],
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(10)).cast("int")), F.lit(0.0),
                        lambda s, i: s + 1.0 / F.log2(i + 1.0))
    def mean(c: Column, name: str) -> Column:
        return F.round(F.avg(c), 6).alias(name)

    return per_query.withColumn("ideal", ideal).groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        *[mean(F.col(f"h{k}") / F.col("n_rel"), f"recall_{k}") for k in (1, 3, 5, 10)],
        *[mean(F.col(f"h{k}") / F.lit(float(k)), f"precision_{k}") for k in (3, 5, 10)],
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"),
        mean(F.col("dcg") / F.col("ideal"), "ndcg_10"),
        *[mean((F.col(f"h{k}") > 0).cast("int"), f"hit_{k}") for k in (1, 3, 5)])


def latency_percentiles(samples: DataFrame, by: str, *, points: tuple[float, ...] = (0.5, 0.95), cuts: int = 200) -> DataFrame:
    """Exact interpolated percentiles of ``ms`` per stage.

    Equal values fold first. A mergeable sketch gives ``cuts`` rough bounds per
    stage; counts per range tell which ranges hold the wanted ranks, and only
    those are ordered. A stage with most of the samples is thus never sorted or
    held by one task.
    """
    counted = samples.groupBy(by, "ms").agg(F.count("*").alias("c"))
    grid = [i / cuts for i in range(1, cuts)]
    bounds = samples.groupBy(by).agg(F.percentile_approx("ms", grid, 10 * cuts).alias("bounds"))
    placed = counted.join(bounds, by).withColumn(
        "b", F.size(F.filter("bounds", lambda x: x < F.col("ms")))).drop("bounds")
    ranges = placed.groupBy(by, "b").agg(F.sum("c").alias("c"))
    stage, order = Window.partitionBy(by), Window.partitionBy(by).orderBy("b")
    ranges = ranges.select(by, "b", (F.sum("c").over(order) - F.col("c")).alias("before"), "c", F.sum("c").over(stage).alias("n"))
    wanted = F.array(*[F.struct(
        F.lit(p).alias("p"), (F.lit(p) * (F.col("n") - 1)).alias("pos"), F.lit(up).alias("up")) for p in points for up in (0, 1)])
    asked = ranges.select(by, "b", "before", "c", "n", F.explode(wanted).alias("w")).withColumn(
        "rank", F.when(F.col("w.up") == 1, F.ceil("w.pos")).otherwise(F.floor("w.pos"))
    ).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
    held = placed.join(asked.select(by, "b").distinct(), [by, "b"], "left_semi")
    inner = Window.partitionBy(by, "b").orderBy("ms")
    cum = held.select(by, "b", "ms", (F.sum("c").over(inner) - F.col("c")).alias("skip"), F.col("c").alias("k"))
    found = asked.join(cum, [by, "b"]).filter(
        (F.col("rank") >= F.col("before") + F.col("skip")) & (F.col("rank") < F.col("before") + F.col("skip") + F.col("k")))

    def value(p: float) -> Column:
        low = F.max(F.when((F.col("w.p") == p) & (F.col("w.up") == 0), F.col("ms")))
        high = F.max(F.when((F.col("w.p") == p) & (F.col("w.up") == 1), F.col("ms")))
        part = F.max(F.when(F.col("w.p") == p, F.col("w.pos") - F.floor("w.pos")))
        return F.round(low + (high - low) * part, 4).alias(f"p{round(100 * p)}")

    return found.groupBy(by).agg(F.max("n").alias("n"), *[value(p) for p in points])


def recall_delta(metrics: DataFrame, metric: str = "recall_10") -> DataFrame:
    """Isolated against combined runs, per source."""
    wide = metrics.groupBy("source").pivot("run", ["isolated", "combined"]).agg(F.first(metric))
    return wide.withColumn("delta", F.round(F.col("combined") - F.col("isolated"), 6))


def golden_checks(answers: DataFrame) -> DataFrame:
    """``must_contain_any, must_cite_any, must_not_contain`` against answers.

    A refusal needs neither fact nor citation, but no answer may hold a
    forbidden text.
    """
    a = F.col("answer")
    refused = tx.refused(a)

    def any_in(items: str, fold: bool = True) -> Column:
        return F.exists(items, lambda x: _contains(a, x) if fold else F.contains(a, x))

    return (
        answers.withColumn("has_fact", refused | any_in("must_contain_any"))
        .withColumn("has_source", refused | any_in("must_cite_any", fold=False))
        .withColumn("clean", ~any_in("must_not_contain"))
        .withColumn("ok", F.col("has_fact") & F.col("has_source") & F.col("clean")))


