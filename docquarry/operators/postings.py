"""Postings: which chunks hold which words, kept with the index.

A question word counts as found where the text holds it as a substring. Words
are runs of letters, digits and underscores, so a text holds a word just if one
of the text's own such runs (tokens) does. ``tokens`` lists the distinct tokens
of each chunk, in folders by ``slot`` and sorted, so a search reads the slots of
its tokens; ``grams`` lists what starts at each place of every token of the
vocabulary, three letters long or up to the token's end, so that each of a
token's substrings of one to three letters is the head of a gram. A word meets
the vocabulary by its rarest gram, is verified there, and meets the chunks
through an equi-join on tokens: no text is read again, and a token that stands
in a third of all chunks is rows like others.

Texts are cut into words once per batch: the vocabulary is read from the
batch's stored tokens.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS = "token string, in_name boolean, id {id}, slot int"
SLOTS = 64
GRAM = 3


@dataclass(frozen=True)
class Postings:
    """``tokens`` (token, in_name, id), ``grams`` (gram, token; may repeat), ``sizes`` (n: chunks, to be summed)."""

    tokens: DataFrame
    grams: DataFrame
    sizes: DataFrame


def _tokens_of(text: Column) -> Column:
    # splitting at all else gives the same words as matching them, and is faster
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), "")


def _grams_of(token: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substr(token, i, F.lit(GRAM))))


def _heads_of(gram: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda n: F.substr(gram, F.lit(1), n))


def _grams_from(tokens: DataFrame) -> DataFrame:
    return tokens.select("token").distinct().select("token", F.explode(_grams_of(F.col("token"))).alias("gram"))


def postings_of(chunks: DataFrame) -> Postings:
    """The postings of chunks (id, content, source)."""
    both = F.array(*(F.struct(F.coalesce(_tokens_of(F.col(c)), F.array().cast("array<string>")).alias("all"), F.lit(c == "source").alias("in_name")) for c in ("content", "source")))
    tokens = chunks.select("id", F.explode(both).alias("b")).select("id", "b.in_name", F.explode("b.all").alias("token"))
    return Postings(tokens, _grams_from(tokens), chunks.agg(F.count("*").alias("n")))


def write_postings(chunks: DataFrame, path: str) -> None:
    """Adds the postings of new chunks to those at ``path``, as a batch of their own."""
    made, batch = postings_of(chunks), f"batch=b{uuid.uuid4().hex}"
    slotted = made.tokens.withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int"))
    # rebalancing splits large slots and merges small ones, without a pass to sample
    slotted.hint("rebalance", "slot").sortWithinPartitions("slot", "token", "id").write.partitionBy("slot").parquet(f"{path}/tokens/{batch}")
    grams = _grams_from(chunks.sparkSession.read.schema("token string").parquet(f"{path}/tokens/{batch}"))
    grams.hint("rebalance", "gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams/{batch}")
    made.sizes.write.parquet(f"{path}/sizes/{batch}")


def read_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(spark.read.parquet(f"{path}/tokens").drop("batch"), spark.read.schema("token string, gram string").parquet(f"{path}/grams"),
                    spark.read.schema("n bigint").parquet(f"{path}/sizes"))


def _spread_words(words: DataFrame, postings: Postings) -> DataFrame:
    """(word, token): the vocabulary's tokens that hold each word."""
    parts = F.when(F.length("word") <= GRAM, F.array("word")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substr("word", i, F.lit(GRAM))))
    asked = words.select("word", F.explode(parts).alias("gram"))
    heads = postings.grams.select("token", F.explode(_heads_of(F.col("gram"))).alias("gram"))
    sizes = heads.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(sizes, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # a token holds a short gram at several places, and several batches hold a token
    return rarest.join(heads, "gram").filter(F.contains("token", "word")).select("word", "token").distinct()


def word_hits(words: DataFrame, postings: Postings, *, names: bool = True, starts: bool = False) -> DataFrame:
    """Distinct (word, id): chunks whose text, or (``names``) source name, holds each distinct ``word``.

    ``starts``: a word also counts where the source name has a token of three or more characters that the word starts with.
    """
    words = words.select("word").distinct()
    spread = _spread_words(words, postings).withColumn("name_only", F.lit(False))
    if starts:
        begin = F.transform(F.sequence(F.lit(3), F.length("word")), lambda n: F.substr("word", F.lit(1), n))
        short = words.filter(F.length("word") >= 3).select("word", F.explode(begin).alias("token"), F.lit(True).alias("name_only"))
        spread = spread.unionByName(short)
    tokens = postings.tokens
    if "slot" in tokens.columns:  # stored: only the slots of these tokens are read
        spread = spread.withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int"))
        met = tokens.join(spread, ["slot", "token"])
    else:
        met = tokens.join(spread, "token")
    fits = F.col("in_name") | ~F.col("name_only") if names else ~F.col("in_name")
    return met.filter(fits).select("word", "id").distinct()


def word_df(words: DataFrame, postings: Postings) -> DataFrame:
    """``(word, df, n)`` of each distinct word: chunks whose text or source name holds it, and all chunks."""
    found = word_hits(words, postings).groupBy("word").agg(F.count("*").alias("df"))
    n = postings.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return words.select("word").distinct().join(found, "word", "left").fillna(0, ["df"]).withColumn("n", n)


def weighted_hits(terms: DataFrame, postings: Postings, **options) -> DataFrame:
    """``(query_id, id, score)`` of questions (query_id, terms, weights) and the chunks that hold at least one of their terms: the share of weight found."""
    each = terms.select("query_id", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("query_id", F.col("t.terms").alias("word"), F.col("t.weights").alias("w"))
    # equal words of a question count together
    each = each.groupBy("query_id", "word").agg(F.sum("w").alias("w"))
    total = Window.partitionBy("query_id")
    each = each.withColumn("share", F.sum("w").over(total))
    met = each.join(word_hits(each, postings, **options), "word")
    return met.groupBy("query_id", "id").agg(F.round(F.sum("w") / F.first("share"), 9).alias("score"))
