"""Checks of answers against the chunks they were given.

Sentences and chunks of an answer are rows that meet by the answer's id. What a
sentence needs to know of a chunk (does it support it, how many words do they
share, which of its words occur) is worked out on the pair; pairs fold to one
row per sentence with ``max_by`` and unions of words, so no task gathers the
texts of an answer and an answer may have any number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions import text as tx
from docquarry.functions.text import SPACE, let
from docquarry.session import fan_out


def _hashes(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _chunk_rows(evidence: DataFrame) -> DataFrame:
    """Retrieved chunks with lower-case text and its distinct words, worked out once per chunk.

    Words travel as 64-bit hashes, which arrays of pairs are compared by much faster; they only order chunks.
    """
    return fan_out(evidence, "answer_id", sized_by=evidence).select(
        "answer_id", F.col("rank").cast("int").alias("rank"), "source", "location", F.lower("content").alias("hay")
    ).withColumn("words", _hashes(tx.words(F.col("hay"))))


def meet_chunks(sentences: DataFrame, evidence: DataFrame, where: Column | bool = True) -> DataFrame:
    """Every row of ``sentences`` (``answer_id, …``) that is of ``where`` with each chunk of its answer as ``chunk``; null where there is none."""
    rows = _chunk_rows(evidence).select(
        F.col("answer_id").alias("_of"), F.struct("rank", "source", "location", "hay", "words").alias("chunk"))
    return sentences.join(rows, (F.col("answer_id") == F.col("_of")) & where, "left").drop("_of")


# --- sentence labels ---------------------------------------------------------------------

_PLACEHOLDER = fixed.PLACEHOLDER_NAMES.replace("{s}", SPACE + "+")
_PLACEHOLDER = rf"(?i)\[(?:{_PLACEHOLDER})\]|\*\*(?:{_PLACEHOLDER})\*\*"
_TRANSITION = "(?i)" + fixed.TRANSITION_PATTERN.replace("{s0}", SPACE + "+")


def _place(facts: Column, own: Column, chunk: Column) -> Column:
    """Where a supporting chunk that shares words with the sentence stands, best first in order; else null."""
    shared = F.size(F.array_intersect(chunk["words"], own))
    return F.when((shared > 0) & tx.supported_by(facts, chunk["hay"]), F.struct(
        (-shared).alias("o"), chunk["rank"].alias("rank"), chunk["source"].alias("source"), chunk["location"].alias("location")))


def _cited(facts: Column, cite: Column, chunk: Column) -> Column:
    """What of a sentence occurs in a chunk that its citation names; null where the citation names another."""
    hay = chunk["hay"]
    return F.when(tx.same_source(chunk["source"], cite["source"]), F.struct(
        (F.contains(hay, facts["text"]) | F.contains(hay, facts["head"])).alias("literal"),
        F.filter(F.array_distinct(facts["years"]), lambda y: F.contains(hay, y)).alias("years"),
        F.filter(F.array_distinct(facts["words"]), lambda w: F.contains(hay, w)).alias("words")))


def _own_label(core: Column) -> Column:
    """The label of sentences that need no support, else null."""
    plain = F.translate(core, "’`", "''")
    return (
        F.when(core.rlike("(?i)" + fixed.META_PATTERN), "meta")
        .when(core.rlike(_PLACEHOLDER), "placeholder")
        .when(plain.rlike("(?i)" + fixed.FALLBACK_PATTERN), "fallback")
        .when(F.size(tx.split_space(core)) <= 4, "short")
        .when(core.rlike(_TRANSITION), "transition"))


def _with_facts(answers: DataFrame, found: Column) -> DataFrame:
    """One row per sentence: ``answer_id, pos, sentence, core, facts, own``."""
    cut = tx.unroll(fan_out(answers, "answer_id", sized_by=answers), found, "pos", "sentence", ["answer_id"])
    return cut.withColumn("core", tx.strip_citations(F.col("sentence"))).select(
        "*", tx.sentence_facts(F.col("sentence")).alias("facts"), _hashes(tx.long_words(F.col("core"))).alias("own"))


def ground_sentences(answers: DataFrame, evidence: DataFrame, *, strict_meta: bool = False) -> DataFrame:
    """``(answer_id, pos, label, text)`` for every sentence; ``text`` is null when the sentence goes."""
    s = _with_facts(answers, tx.sentences(tx.rewrite_endnotes(F.col("answer")))).withColumn("label", _own_label(F.col("core")))
    # a row for each citation, or one without; chunks join by the answer's id, and only where the sentence needs support
    s = s.select("*", F.posexplode_outer(tx.citations(F.col("sentence"))).alias("k", "cite"))
    chunk, facts = F.col("chunk"), F.col("facts")
    pairs = meet_chunks(s, evidence, F.col("label").isNull())
    # the pair's findings are one column that the fold reads several times, so that texts end here
    seen = pairs.select(
        "answer_id", "pos", "k", "label", "sentence", "core", "facts",
        F.when(chunk.isNotNull(), F.struct(
            F.when(F.col("k").isNull(), _place(facts, F.col("own"), chunk)).alias("place"),
            F.when(F.col("k").isNotNull(), _cited(facts, F.col("cite"), chunk)).alias("cited"))).alias("p"))

    def together(items: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(F.col("p.cited")[items]))).alias(items)

    per_cite = seen.groupBy("answer_id", "pos", "k").agg(
        *(F.first(c).alias(c) for c in ("label", "sentence", "core", "facts")), F.min("p.place").alias("b"),
        F.bool_or("p.cited.literal").alias("literal"), together("years"), together("words"))
    holds = F.coalesce(F.col("literal").isNotNull() & tx.supported_with(
        facts, F.col("literal"), lambda y: F.array_contains("years", y), lambda w: F.array_contains("words", w)), F.lit(False))
    folded = per_cite.groupBy("answer_id", "pos").agg(
        *(F.first(c).alias(c) for c in ("label", "sentence", "core", "b")),
        F.bool_and(F.when(F.col("k").isNotNull(), holds)).alias("holds"))
    label = F.coalesce("label", F.when(F.col("holds"), "cited").when(~F.col("holds"), "bad_citation").when(
        F.col("b").isNotNull(), "auto_cited").otherwise("unsupported"))
    gone = F.col("label").isin("placeholder", "bad_citation", "unsupported", *(["meta"] if strict_meta else []))
    attached = F.concat(F.rtrim("core", F.lit(".")), F.lit(" [Citation: "), "b.source", F.lit(", "), "b.location", F.lit("]."))
    return folded.withColumn("label", label).select("answer_id", "pos", "label", F.when(F.col("label") == "auto_cited", attached).when(
        ~gone, F.col("sentence")).alias("text"))


def ground_answers(answers: DataFrame, evidence: DataFrame, *, strict_meta: bool = False) -> DataFrame:
    """Keep, drop or cite every sentence of every answer.

    Adds ``sentences`` (``array<struct<label,text>>``) and ``grounded``, the
    kept sentences joined, or the fixed not-found answer. ``answer_id`` names an answer.
    """
    judged = ground_sentences(answers, evidence, strict_meta=strict_meta)
    own = judged.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "text"))).alias("_s"))
    none = F.array().cast("array<struct<label:string,text:string>>")
    both = answers.join(own, "answer_id", "left").withColumn("sentences", F.coalesce(
        F.transform("_s", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))), none)).drop("_s")
    kept = F.array_join(F.filter(F.transform("sentences", lambda x: x["text"]), lambda t: t.isNotNull()), " ")
    return both.withColumn("_kept", tx.strip(kept)).withColumn(
        "grounded", F.when(F.col("_kept") != "", F.col("_kept")).otherwise(fixed.NOT_FOUND_ANSWER)).drop("_kept")


def citation_match(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every citation of an answer with the number of retrieved chunks it matches."""
    cites = tx.unroll(answers, tx.citations(F.col("answer")), "pos", "c", ["answer_id"])
    both = cites.join(evidence.select("answer_id", F.col("source").alias("_from")), "answer_id", "left")
    matched = F.count_if(tx.same_source(F.col("_from"), F.col("c.source")))
    return both.groupBy("answer_id", "pos").agg(F.first("c").alias("c"), matched.cast("int").alias("n_match")).select(
        "answer_id", "pos", "c.source", "c.location", "n_match")


def sentence_support(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(answer_id, pos, n_supporting)``: how many retrieved chunks support each sentence."""
    both = meet_chunks(_with_facts(answers, tx.sentences(F.col("answer"))), evidence).filter(F.col("chunk").isNotNull())
    n = F.count_if(tx.supported_by(F.col("facts"), F.col("chunk.hay")))
    return both.groupBy("answer_id", "pos").agg(n.cast("int").alias("n_supporting"))


def auto_cite(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """For every sentence the chunk that supports it best."""
    s = _with_facts(answers, tx.sentences(F.col("answer")))
    seen = meet_chunks(s, evidence).select("answer_id", "pos", "sentence", _place(F.col("facts"), F.col("own"), F.col("chunk")).alias("p"))
    at = F.min_by(F.struct("p.source", "p.location"), "p")  # read several times, so the texts of the pairs end before
    return seen.groupBy("answer_id", "pos").agg(F.first("sentence").alias("sentence"), at.alias("b")).select(
        "answer_id", "pos", "sentence", "b.source", "b.location")


# --- claims --------------------------------------------------------------------------------



def sidecar_evidence(evidence: DataFrame) -> DataFrame:
    """Drop image chunks that have a Markdown note of the same name in the same set."""
    base = F.regexp_replace(F.substring_index("source", "/", -1), r"\.[^.]*$", "")
    media = F.contains("source", F.lit("multimedia/"))
    notes = evidence.filter(media & F.col("source").endswith(".md")).select("answer_id", base.alias("_base")).distinct()
    is_image = media & F.col("source").rlike(r"\.(?:png|jpg|jpeg|webp)$")
    keyed = evidence.withColumn("_base", F.when(is_image, base))
    return keyed.join(notes, ["answer_id", "_base"], "left_anti").drop("_base")


def evidence_context(evidence: DataFrame) -> DataFrame:
    """One context per answer: ``source | location | content`` lines in rank order."""
    line = F.concat_ws(" | ", "source", "location", "content")
    kept = sidecar_evidence(fan_out(evidence, "answer_id", sized_by=evidence)).filter(F.coalesce("content", F.lit("")) != "")
    return kept.groupBy("answer_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", line.alias("line")))), lambda x: x["line"]),
        "\n").alias("context"))


def unsupported_claims(answer: Column, context: Column, own_names: tuple[str, ...] = ()) -> Column:
    """Claims without support; refusals need none, an empty context supports nothing."""
    return (
        F.when(tx.refused(answer), F.array().cast("array<string>"))
        .when(tx.is_blank(context), F.array(F.lit(fixed.NO_CONTEXT)))
        .otherwise(let(tx.comparable(context), lambda x: F.filter(
            tx.claims(answer, own_names), lambda c: ~tx.claim_supported(c, x, context_is_comparable=True)))))


def grounding_check(answers: DataFrame, *, answer: str = "answer", context: str = "context",
                    own_names: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``unsupported`` and ``ok``; citation footers are not claims."""
    found = unsupported_claims(tx.strip_footers(F.col(answer)), F.col(context), own_names)
    return answers.withColumn("unsupported", found).withColumn("ok", F.size("unsupported") == 0)


def guarded_answers(answers: DataFrame, evidence: DataFrame, *, keep_trace: int = 10) -> DataFrame:
    """Answers whose claims do not all hold become the strict refusal."""
    checked = grounding_check(answers.join(evidence_context(evidence), "answer_id", "left"))
    free = tx.refused(F.col("answer"))
    return checked.withColumn(
        "response", F.when(free | F.col("ok"), F.col("answer")).otherwise(fixed.STRICT_REFUSAL)
    ).withColumn("trace", F.when(~free & ~F.col("ok"), F.slice("unsupported", 1, keep_trace)))


# --- tool traces ----------------------------------------------------------------------------

def longest_evidence(tool_results: DataFrame) -> DataFrame:
    """The longest tool result per answer; the earliest of equally long ones."""
    best = F.max_by(F.struct("tool", "content"), F.struct(F.length("content"), -F.col("seq")))
    return tool_results.groupBy("answer_id").agg(best.alias("b")).select("answer_id", "b.tool", "b.content")


def result_count(kind: Column, n_items: Column, has_error: Column, has_source: Column) -> Column:
    """Lists count their items, an error without a source counts 0, else 1."""
    return F.when(kind == "list", n_items).when(has_error & ~has_source, F.lit(0)).otherwise(F.lit(1))


def tool_trace_summary(trace: DataFrame) -> DataFrame:
    return trace.groupBy("answer_id").agg(
        F.count("*").alias("calls"), F.sum("duration_ms").alias("duration_ms"),
        F.max("iteration").alias("iterations"), F.sum("result_count").alias("results"))


