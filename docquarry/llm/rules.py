"""Quality rules with Spark expressions only.

Two fixed rules (too few words; too many words in repeated windows) and one by
divergence: a text's histograms of character classes and of common words are
held against references of languages by the Jensen-Shannon distance (0: alike,
1: nothing in common). A text passes if one language has both distances within
bounds. Each comparison has a length below which a histogram says too little
and is passed over.

All work is per row, in one pass without a shuffle, so no key can be hot.

Defined results: null text has no words and fails; characters are code points;
repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import free_names

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RX = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Reference shares. Character classes in the order of CLASSES; common words as shares of all words.
CLASSES = ("letters without case or in lower case", "capitals", "digits", "blanks", "punctuation", "others")
CLASS_SHARES = {
    "en": (0.797, 0.016, 0.004, 0.164, 0.017, 0.002),
    "de": (0.804, 0.016, 0.004, 0.156, 0.018, 0.002),
    "fr": (0.795, 0.016, 0.004, 0.165, 0.018, 0.002),
    "es": (0.799, 0.016, 0.004, 0.162, 0.017, 0.002),
}
WORD_SHARES = {
    "en": {"the": 0.055, "of": 0.034, "and": 0.023, "to": 0.018, "in": 0.016, "a": 0.015},
    "de": {"der": 0.056, "die": 0.032, "und": 0.023, "in": 0.018, "den": 0.014, "von": 0.012},
    "fr": {"de": 0.056, "la": 0.032, "le": 0.023, "et": 0.018, "les": 0.015, "des": 0.012},
    "es": {"de": 0.056, "la": 0.032, "que": 0.023, "el": 0.018, "en": 0.014, "y": 0.012},
}


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules; ``None`` switches a bound off."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    class_distance: float | None = 0.20
    class_min_chars: int = 400
    word_distance: float | None = 0.27
    word_min_words: int = 80


def word_list(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RX)).otherwise(F.array().cast("array<string>"))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def window_hashes(hashes: Column, size: Column, n: int) -> Column:
    """A hash of each window of ``n`` words (``n`` a power of two), by doubling."""
    done = 1
    while done < n:
        step = done
        hashes = F.filter(F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.greatest(size, F.lit(1))), lambda a, b: F.xxhash64(a, b)),
                          lambda _, i: i <= size - 2 * step)
        done *= 2
    return hashes


def repeated_words(windows: Column, n: int) -> Column:
    """How many words are in windows found twice or more; linear in the windows but for a sort."""
    entries = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(entries, n))


def _covered(entries: Column, n: int) -> Column:
    return F.aggregate(
        F.array(entries), F.lit(0).cast("long"),  # binds the sorted array once
        lambda _, e: F.aggregate(
            F.array(F.array_sort(F.filter(F.transform(e, lambda x, i: F.when(
                (x["h"] == F.get(e, i - 1)["h"]) | (x["h"] == F.get(e, i + 1)["h"]), x["i"])), lambda x: x.isNotNull()))),
            F.lit(0).cast("long"),
            lambda _a, p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))),
                F.lit(0).cast("long"), lambda s, x: s + x)))


def distance(shares: list[tuple[Column, float]]) -> Column:
    """The Jensen-Shannon distance of (share in the text, reference share) pairs."""
    total = F.lit(0.0)
    for own, ref in shares:
        middle = (own + F.lit(ref)) / 2
        total = total + F.when(own > 0, own * F.ln(own / middle)).otherwise(0.0)
        if ref > 0:
            total = total + F.lit(ref) * F.ln(F.lit(ref) / middle)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * math.log(2)))


def quality(docs: DataFrame, text_col: str = "text", limits: Limits = Limits(), class_shares: dict = CLASS_SHARES,
            word_shares: dict = WORD_SHARES) -> DataFrame:
    """``docs`` with the counts, both distances (of the nearest language) and the verdict ``kept``.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept. Columns of these names are replaced, all others stay. Write the result before filtering on
    it: the optimizer moves such a filter into the counting expressions and repeats them.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    names = free_names(docs, added)
    inner = [f"c{i}" for i in range(len(names))]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    vocabulary = sorted({w for shares in word_shares.values() for w in shares})
    letters = {w: chr(ord("a") + i) if i < 26 else chr(0x100 + i) for i, w in enumerate(vocabulary)}

    d = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    d = d.select(
        *inner, word_list(F.col("t")).alias("w"), lines.alias("lines"), F.length("t").alias("chars"),
        F.length(without(F.col("t"), BLANKS)).alias("word_chars"),
        F.regexp_replace("t", "[\\p{Ll}\\p{Lo}\\p{Lm}\\p{M}]+", "").alias("rest"))
    d = d.select(
        *inner, "chars", F.col("word_chars").cast("long").alias("word_chars"), F.size("w").alias("n"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.transform("w", lambda x: F.xxhash64(x)), F.size("w"), limits.repeat_window).alias("windows"),
        F.array_join(F.transform(F.filter("w", lambda x: x.isin(vocabulary)),
                                 lambda x: F.element_at(F.create_map(*(F.lit(y) for pair in letters.items() for y in pair)), x)), "").alias("hits"),
        "rest", F.length(F.regexp_replace("rest", "\\p{Lu}+", "")).alias("no_caps"),
        F.length(F.regexp_replace("rest", "\\p{Nd}+", "")).alias("no_digits"),
        F.length(F.regexp_replace("rest", "[.,;:!?'\"()\\-]+", "")).alias("no_marks"),
        F.length(without(F.col("rest"), SYMBOLS)).alias("no_symbols"))
    rest = F.length("rest")
    d = d.withColumn("n_words", F.col("n").cast("long")).withColumn("n_symbols", (rest - F.col("no_symbols")).cast("long"))
    d = d.withColumn("n_repeat_words", repeated_words(F.col("windows"), limits.repeat_window))
    counts = [F.col("chars") - rest, rest - F.col("no_caps"), rest - F.col("no_digits"), F.col("chars") - F.col("word_chars"), rest - F.col("no_marks")]
    per_char = [c / F.greatest(F.col("chars"), F.lit(1)) for c in counts]
    per_char.append(1.0 - sum(per_char[1:], per_char[0]))
    d = d.select(*inner, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", F.array(*per_char).alias("classes"),
                 F.array(*((F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(letters[w])))) / F.greatest(F.col("n_words"), F.lit(1))
                           for w in vocabulary)).alias("common"))
    nearest = []
    for language in class_shares:
        by_class = distance([(F.greatest(F.get("classes", F.lit(i)), F.lit(0.0)), p) for i, p in enumerate(class_shares[language])])
        own = [(F.get("common", F.lit(vocabulary.index(w))), p) for w, p in word_shares[language].items()]
        left = (F.greatest(1.0 - sum((q for q, _ in own[1:]), own[0][0]), F.lit(0.0)), 1.0 - sum(word_shares[language].values()))
        nearest.append(F.struct((by_class + distance([*own, left])).alias("sum"), by_class.alias("by_class"), distance([*own, left]).alias("by_word")))
    d = d.withColumn("near", F.array_min(F.array(*nearest)))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    good = ~F.col("base_failed")
    if limits.class_distance is not None:
        good &= (F.col("chars") < limits.class_min_chars) | (F.col("near.by_class") <= limits.class_distance)
    if limits.word_distance is not None:
        good &= (F.col("n_words") < limits.word_min_words) | (F.col("near.by_word") <= limits.word_distance)
    return d.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", F.round("near.by_class", 6).alias("class_distance"), F.round("near.by_word", 6).alias("word_distance"),
                    good.alias("kept"))
