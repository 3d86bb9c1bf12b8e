"""From retrieved chunks to checked answers, for whole question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions import text as tx
from docquarry.operators.grounding import ground_answers
from docquarry.session import fan_out


def best_sentence(query: Column, content: Column) -> Column:
    """``struct<shared, text>``: the first sentence that shares most words with the question."""
    def of(terms: Column) -> Column:
        def scored(s: Column, i: Column) -> Column:
            shared = F.size(F.array_intersect(terms, tx.words(F.lower(s))))
            return F.struct(shared.alias("shared"), (-i).alias("o"), s.alias("text"))

        return F.array_max(F.transform(tx.sentences(content), scored))

    return tx.let(tx.let(F.array_distinct(tx.keywords(query)), of), lambda best: F.struct(
        F.coalesce(best["shared"], F.lit(0)).alias("shared"), best["text"].alias("text")))


def extractive_answers(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Default answer generator: the best sentence of the retrieved chunks, cited.

    A model takes this place through :func:`docquarry.functions.seams.generator`.
    """
    both = retrieved.join(questions.select("query_id", "query"), "query_id")
    picked = fan_out(both, "query_id", "rank").withColumn(
        "b", best_sentence(F.col("query"), F.col("content")))
    top = picked.groupBy("query_id").agg(F.max_by(
        F.struct("b.text", "source", "location", "b.shared"), F.struct(F.col("b.shared"), -F.col("rank"))).alias("t"))
    cited = F.concat(
        F.rtrim(F.col("t.text"), F.lit(".")), F.lit(" [Citation: "), F.col("t.source"), F.lit(", "), F.col("t.location"), F.lit("]."))
    return top.select("query_id", F.when(F.col("t.shared") > 0, cited).otherwise(
        "I cannot find this in the indexed documents.").alias("answer"))


def answer_questions(questions: DataFrame, retrieved: DataFrame, raw: DataFrame, contact: str | None = None) -> DataFrame:
    """Final answers: grounded text, citations, the retrieved context, refused or not.

    ``raw`` holds ``query_id, answer``. Questions without retrieved chunks and
    answers that the checks empty become refusals that name a contact.
    """
    suffix = f", please contact {contact}" if contact else ""
    nothing = fixed.ROUTE_REFUSAL + (suffix or ". Upload more relevant material to the S3 bucket.")
    asked = questions.select("query_id", "query").join(raw.select("query_id", "answer"), "query_id", "left").withColumnRenamed(
        "query_id", "answer_id")
    evidence = retrieved.select(F.col("query_id").alias("answer_id"), "rank", "source", "location", "content")
    scores = retrieved.groupBy(F.col("query_id").alias("answer_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "source", "location", "score"))).alias("retrieved"))
    empty = F.coalesce("answer", F.lit("")).alias("answer")
    grounded = ground_answers(asked.select("answer_id", "query", empty), evidence).join(scores, "answer_id", "left")
    refused = F.col("retrieved").isNull() | tx.no_answer(F.col("grounded"))
    return grounded.select(
        F.col("answer_id").alias("query_id"), "query",
        F.when(F.col("retrieved").isNull(), nothing).when(refused, fixed.ROUTE_REFUSAL + suffix).otherwise(F.col("grounded")).alias("response"),
        F.when(refused, F.array().cast("array<struct<source:string,location:string>>")).otherwise(
            tx.citations(F.col("grounded"))).alias("citations"),
        F.coalesce("retrieved", F.array().cast("array<struct<rank:int,source:string,location:string,score:double>>")).alias("retrieved"),
        refused.alias("refused"))
