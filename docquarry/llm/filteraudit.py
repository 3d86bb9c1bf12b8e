"""How the filters of a corpus interact: what each removes in every order they could be applied in.

Every filter's failing rows are stored as an id relation of its own. For a
prefix of an order, the rows that its next filter removes are that filter's
relation left-anti joined with the relations of the filters before it; the
order within a prefix does not matter, so each set of filters is worked out
once. Labels are met by left-semi joins. The five joins of a full audit share
one exchange, as all relations have the row number as their key; only failing
rows take part, without texts.

A copy filter fails a row whose text is also found under a smaller id. Texts
are compared by SHA-256; texts with more than a thousandth of all rows are
joined by a broadcast of fewer than 1,024 digests (``join_hot``).

Defined results: null text is empty and is judged like any other text; a null
part is the empty string; rows are documents of their own, also with equal or
null ids; a null id is larger and smaller than none and has no labels; any of
several label rows of an id counts; no documents give no rows; texts of any
length are read whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.rules import word_list
from docquarry.llm.shared import join_hot, persist, persist_by

Rule = Callable[[Column, Column], Column]

# Failure conditions on a text and its words.
RULES: dict[str, Rule] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def judged_rows(docs: DataFrame, rules: dict[str, Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A stored row for each document: number, id, part, digest of the text, and the names of the rules that it fails."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", word_list(F.col("text")))
    failed = F.array_compact(F.array(*(F.when(rule(F.col("text"), F.col("words")), F.lit(name)) for name, rule in rules.items())))
    return persist(d.select(F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                            failed.cast("array<string>").alias("failed")), "judged")


def failing_ids(rows: DataFrame, copies: str | None = "E") -> DataFrame:
    """The stored id relations (filter, row, id, part), a folder each; ``copies`` names the filter of texts found under a smaller id."""
    fails = rows.select("row", "id", "part", F.explode("failed").alias("filter"))
    if copies is not None:
        texts = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
        found = join_hot(rows.select("row", "id", "part", "digest"), persist(texts, "texts"), "digest", "n", rows.count())
        fails = fails.unionByName(found.filter("id > least").select("row", "id", "part", F.lit(copies).alias("filter")))
    return persist_by(fails, "fails", "filter")


def removals(fails: DataFrame, labels: DataFrame, names: list[str], label_id: str = "doc_id") -> DataFrame:
    """(part, filter, before, removed, good_lost, toxic_lost) of each filter after each set of others; sets without removals are left out."""
    def labelled(column: str) -> DataFrame:
        return labels.filter(F.col(column) == 1).select(F.col(f"`{label_id}`").alias("id"))

    marked = fails.withColumn("kind", F.lit("all"))
    for column, kind in (("quality", "good"), ("toxic", "toxic")):
        marked = marked.unionByName(fails.join(labelled(column), "id", "left_semi").select(*fails.columns).withColumn("kind", F.lit(kind)))
    left = marked.select("row", "part", "filter", "kind", F.lit("").alias("before"))
    for name in names:
        # with and without this filter before; with it, its own failing ids are gone already
        either = F.when(F.col("filter") == name, F.array("before")).otherwise(F.array("before", F.concat("before", F.lit(name))))
        gone = fails.filter(F.col("filter") == name).select(F.col("row").alias("gone"))
        left = left.withColumn("before", F.explode(either)).join(gone, (F.col("row") == F.col("gone")) & F.col("before").endswith(name), "left_anti")
    count = {"removed": "all", "good_lost": "good", "toxic_lost": "toxic"}
    return left.groupBy("part", "filter", "before").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(c) for c, k in count.items()))


def filter_audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, copies: str | None = "E", id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes, finds gone already, and loses of labelled rows.

    Filters have names of one character. Columns: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (the filter's removals summed over all orders).
    """
    names = sorted([*rules, *([] if copies is None else [copies])])
    rows = judged_rows(docs, rules, id_col, text_col, part_col)
    counts = persist(removals(failing_ids(rows, copies), labels, names), "removals")
    orders = ["".join(p) for p in permutations(names)]
    grid = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    grid = grid.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1))).withColumn(
        "before", F.array_join(F.array_sort(F.split(F.substr("filter_order", F.lit(1), F.col("step") - 1), "")), ""))
    done = grid.join(counts, ["part", "filter", "before"], "left").fillna(0, ["removed", "good_lost", "toxic_lost"])
    own = Window.partitionBy("part", "filter")
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    done = done.withColumn("fails", F.max(F.when(F.col("step") == 1, F.col("removed"))).over(own)).withColumn(
        "unique_fails", F.max(F.when(F.col("step") == len(names), F.col("removed"))).over(own)).withColumn(
        "shapley", F.sum("removed").over(own)).withColumn("kept", F.col("n") - F.sum("removed").over(so_far))
    return done.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
                       "unique_fails", "good_lost", "toxic_lost", "shapley")
