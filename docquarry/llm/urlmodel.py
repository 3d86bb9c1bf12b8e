"""URL filters with Spark expressions only: rules first, a character language-model ratio for the rest.

URLs that a rule decides are the examples: variable-order Markov models of the
accepted and of the rejected ones. All URLs' characters are counted with the
``order`` characters before them, once; shorter contexts follow by sums. A
context is kept if it precedes more than one in ``share`` of all characters
(both classes together), so each order has fewer than ``share`` contexts,
however large the table. Probabilities are smoothed from the next shorter
context down to an even share of the alphabet.

Kept contexts are closed under suffixes and under dropping the last character,
so they are the states of an automaton: from a state and a character follow the
next state (the longest kept suffix) and the difference of both models'
log-probabilities. A URL is scored by one fold over its characters; the
automaton is a literal of the plan, bounded by ``order * share`` states. There
is no join and no shuffle of pages, so no host or URL can be hot. The score is
the mean difference for a character. The bound between verdicts is calibrated
on every fifth distinct URL (by its hash), which the counts leave out.

Defined results: null URLs and URLs without ``://`` have an empty host and path
and fit no rule (unless one has neither); null counts as an empty text, which
the models judge by its end; repeated rows are judged, counted and calibrated
each; URLs of any length are read whole; without an accepted or a rejected
example every URL without a rule is accepted; empty tables give no rows; other
columns stay, those with names of added columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import free_names, persist

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END, OTHER = "<", ">", "|"  # none of them stands in a URL
ALPHABET = LOWER + "0123456789-._~:/?#[]@!$&'()*+,;=%" + OTHER + END
FOLDS = 5
BINS = 100  # scores are calibrated in steps of 1 / BINS


@dataclass(frozen=True)
class Rule:
    """Decides URLs of ``host`` and all its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class UrlModel:
    """States of the automaton; cell ``state * len(ALPHABET) + character`` has the next state and the gain. Both are lists of numbers, joined by commas."""

    following: str
    gains: str
    first: int
    bound: int = 0  # in steps of 1 / BINS


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (struct size, name, verdict), the first by name among equally long ones; null if none does."""
    found = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                    F.struct(F.lit(-len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_min(F.array(*found))


def letters(url: Column) -> Column:
    """The model's view of a URL: ASCII letters in lower case, characters outside of the alphabet as one."""
    return F.regexp_replace(F.translate(url, UPPER, LOWER), "[^a-z0-9\\-._~:/?#\\[\\]@!$&'()*+,;=%]", OTHER)


def gram_counts(examples: DataFrame, order: int) -> DataFrame:
    """(context of ``order`` characters, char, accepted, rejected) of examples (text, accepted), stored."""
    padded = F.concat(F.lit(START * order), "text", F.lit(END))
    at = examples.select("accepted", padded.alias("p")).select("accepted", "p", F.explode(F.sequence(F.lit(1), F.length("p") - order)).alias("i"))
    grams = at.select("accepted", F.substr("p", F.col("i"), F.lit(order + 1)).alias("gram")).groupBy("gram").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected"))
    return persist(grams.select(F.substring("gram", 1, order).alias("context"), F.substring("gram", order + 1, 1).alias("char"), "accepted", "rejected"), "grams")


def kept_contexts(grams: DataFrame, order: int, share: int) -> DataFrame:
    """A stored row for each kept context, shorter ones and the empty one included: context, accepted, rejected (characters after it), state."""
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda n: F.substr("context", order + 1 - n, n))
    sums = grams.select("accepted", "rejected", F.explode(suffixes).alias("context")).groupBy("context").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    total = grams.agg(F.sum(F.col("accepted") + F.col("rejected"))).first()[0]
    kept = persist(sums.filter(((F.col("accepted") + F.col("rejected")) * share > total) | (F.col("context") == "")), "contexts")
    # at most 1 + order * share rows, as each order's counts sum up to the total
    numbers = kept.agg(F.array_sort(F.collect_list(F.struct(F.length("context").alias("n"), "context"))).alias("all"))
    numbers = numbers.select(F.posexplode("all").alias("state", "c")).select("state", "c.context")
    return persist(kept.join(F.broadcast(numbers), "context"), "states")


def automaton(grams: DataFrame, contexts: DataFrame, order: int, prior: float) -> UrlModel:
    """Cells of all states and characters, with the state of an empty history."""
    alphabet = F.array(*map(F.lit, ALPHABET))
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda n: F.substr("context", order + 1 - n, n))
    seen = grams.select("char", "accepted", "rejected", F.explode(suffixes).alias("context")).join(F.broadcast(contexts.select("context")), "context").groupBy(
        "context", "char").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    cells = contexts.select("context", "state", "accepted", "rejected", F.posexplode(alphabet).alias("code", "char"))
    cells = persist(cells.join(seen, ["context", "char"], "left").fillna(0, ["a", "r"]), "cells")
    even = F.lit(1.0 / len(ALPHABET))
    shorter = cells.filter("context = ''").select("context", "char", *(((F.col(c) + prior * even) / (F.col(n) + prior)).alias(p)
                                                                       for c, n, p in (("a", "accepted", "pa"), ("r", "rejected", "pr"))))
    done = [shorter]
    for n in range(1, order + 1):
        longer = cells.filter(F.length("context") == n).withColumn("suffix", F.substring("context", 2, order))
        below = shorter.select(F.col("context").alias("suffix"), "char", F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        shorter = persist(longer.join(below, ["suffix", "char"]).select("context", "char", ((F.col("a") + prior * F.col("qa")) / (F.col("accepted") + prior)).alias("pa"),
                                                                        ((F.col("r") + prior * F.col("qr")) / (F.col("rejected") + prior)).alias("pr")), "chances")
        done.append(shorter)
    chances = done[0]
    for d in done[1:]:
        chances = chances.unionByName(d)
    # the longest kept suffix of a context and a character; the empty one is always kept
    ahead = cells.select("context", "char", F.concat("context", "char").alias("text")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(order))))
    ahead = ahead.filter(F.col("n") <= F.length("text")).withColumn("suffix", F.substr("text", F.length("text") + 1 - F.col("n"), F.col("n")))
    ahead = ahead.join(F.broadcast(contexts.select(F.col("context").alias("suffix"), F.col("state").alias("next"))), "suffix").groupBy("context", "char").agg(
        F.max_by("next", "n").alias("next"))
    table = cells.select("context", "char", "state", "code").join(ahead, ["context", "char"]).join(chances, ["context", "char"])
    cell = F.struct((F.col("state") * len(ALPHABET) + F.col("code")).alias("cell"), "next", F.round(F.ln("pa") - F.ln("pr"), 6).alias("gain"))
    row = table.agg(F.array_sort(F.collect_list(cell)).alias("t")).select(
        F.array_join(F.col("t.next").cast("array<string>"), ",").alias("f"), F.array_join(F.col("t.gain").cast("array<string>"), ",").alias("g")).first()
    first = contexts.filter(F.lit(START * order).endswith(F.col("context"))).agg(F.max_by("state", F.length("context"))).first()[0]
    return UrlModel(row["f"], row["g"], first)


def mean_gain(text: Column, model: UrlModel) -> Column:
    """The mean gain for a character of ``letters(url)`` and its end."""
    following, gains = (F.split(F.lit(x), ",").cast(f"array<{kind}>") for x, kind in ((model.following, "int"), (model.gains, "double")))
    codes = F.transform(F.filter(F.split(F.concat(text, F.lit(END)), ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def step(at: Column, code: Column) -> Column:
        cell = at["state"] * len(ALPHABET) + code
        return F.struct(F.get(following, cell).alias("state"), (at["sum"] + F.get(gains, cell)).alias("sum"))

    start = F.struct(F.lit(model.first).alias("state"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, step, lambda at: at["sum"] / (F.length(text) + 1))


def calibrated(examples: DataFrame, model: UrlModel) -> UrlModel:
    """``model`` with the bound that tells examples (text, accepted) apart best: most accepted ones reach it, least rejected ones; nearest to 0 among equals."""
    bins = examples.select("accepted", F.floor(mean_gain(F.col("text"), model) * BINS).cast("int").alias("bin")).groupBy("bin").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    # one row in all: bins are bounded, as gains are
    bins = bins.agg(F.collect_list(F.struct("bin", "a", "r")).alias("all"), F.sum("a").alias("a"), F.sum("r").alias("r")).filter("a > 0 AND r > 0")
    edge = bins.select("all", "a", "r", F.explode(F.transform("all", lambda x: x["bin"])).alias("edge"))
    reach = F.filter("all", lambda x: x["bin"] >= F.col("edge"))

    def share(c: str) -> Column:
        return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x[c]) / F.col(c)

    best = edge.select("edge", F.round(share("a") - share("r"), 9).alias("gap")).orderBy(F.desc("gap"), F.abs("edge"), "edge").first()
    return UrlModel(model.following, model.gains, model.first, best["edge"] if best else 0)


def fit(examples: DataFrame, order: int = 5, share: int = 128, prior: float = 4.0) -> UrlModel | None:
    """The model of examples (url, accepted), or none if the counted ones lack an accepted or a rejected one."""
    examples = examples.select(letters(F.coalesce("url", F.lit(""))).alias("text"), "accepted", (F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)) == 0).alias("aside"))
    counted = examples.filter("NOT aside")
    if counted.agg(F.count_distinct("accepted")).first()[0] < 2:
        return None
    grams = gram_counts(counted, order)
    return calibrated(examples.filter("aside"), automaton(grams, kept_contexts(grams, order, share), order, prior))


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", order: int = 5, share: int = 128, prior: float = 4.0) -> DataFrame:
    """``pages`` with host, path, rule (of the longest rule that fits, such as ``net/``, or null), score and verdict (allow or block)."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    names = free_names(pages, ["host", "path", "rule", "score", "verdict"])
    inner = [f"c{i}" for i in range(len(names))]
    rows = pages.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)), url.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    model = fit(rows.filter("fit IS NOT NULL").select("url", (F.col("fit.verdict") == "allow").alias("accepted")), order, share, prior)
    score = F.lit(0.0) if model is None else mean_gain(letters(F.col("url")), model)
    accepted = F.floor(F.col("score") * BINS) >= (model.bound if model else 0)
    rows = rows.withColumn("score", score).withColumn("verdict", F.coalesce("fit.verdict", F.when(accepted, "allow").otherwise("block")))
    return rows.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "host", "path", F.col("fit.name").alias("rule"), "score", "verdict")
