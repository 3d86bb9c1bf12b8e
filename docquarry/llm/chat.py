"""Chat formatting with Spark expressions only.

A conversation becomes ``<s>[role]text[+]text[role]text</s>``: its turns are
collected as structs and sorted by turn, adjacent turns of one role are merged
under one header with ``[+]`` between them, and all pieces are joined. Inside
texts and roles the characters that could form a marker are escaped (``&`` as
``&amp;``, ``[`` as ``&lsqb;``, ``<`` as ``&lt;``; in roles also ``]`` and
``+``), so every ``[`` and ``<`` of the output is the template's own and
``read_chat`` restores the turns. ``loss_mask`` lists, turn by turn, how many
characters of markup precede a text, how many the text has, and whether it is
trained on.

Defined results: null texts and roles count as empty; turns with equal numbers
stand in the order of role and text, null numbers first; repeated rows are
turns of their own; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
TEXT_ESCAPES = [("&", "&amp;"), ("[", "&lsqb;"), ("<", "&lt;")]
ROLE_ESCAPES = [*TEXT_ESCAPES, ("]", "&rsqb;"), ("+", "&plus;")]


def escape(text: Column, table: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for plain, safe in table:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, table: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for plain, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_mask`` (array of struct skip, chars, trained)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"])
        head = F.when(same, F.lit("[+]")).otherwise(F.concat(F.lit("["), escape(t["role"], ROLE_ESCAPES), F.lit("]")))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("trained"))

    pieces = sorted_turns.select("conv", F.transform("turns", piece).alias("pieces"))
    joined = F.concat(F.lit(OPEN), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(CLOSE))
    mask = F.transform("pieces", lambda p, i: F.struct(
        (F.length(p["head"]) + F.when(i == 0, len(OPEN)).otherwise(0)).alias("skip"), F.length(p["body"]).alias("chars"), p["trained"].alias("trained")))
    return pieces.select(F.col("conv").alias(conv_col), joined.alias("formatted"), mask.alias("loss_mask"))


def _bodies(formatted: Column) -> Column:
    """Array of struct role, texts (escaped): one for each header of a formatted conversation."""
    inner = F.substring(formatted, len(OPEN) + 1, F.length(formatted) - len(OPEN) - len(CLOSE))
    blocks = F.split(inner, r"\[(?!\+\])")
    blocks = F.filter(blocks, lambda b, i: i > 0)
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, "]", 1), ROLE_ESCAPES).alias("role"),
        F.split(F.substring(b, F.length(F.substring_index(b, "]", 1)) + 2, F.length(b)), r"\[\+\]").alias("texts")))


def read_chat(formatted: Column) -> Column:
    """The turns (array of struct role, text) of a formatted conversation."""
    return F.flatten(F.transform(_bodies(formatted), lambda b: F.transform(
        b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    texts = F.flatten(F.transform(_bodies(formatted), lambda b: b["texts"]))
    both = F.zip_with(texts, loss_mask, lambda t, m: F.struct(t.alias("t"), m.alias("m")))
    return F.transform(F.filter(both, lambda x: x["m"]["trained"]), lambda x: unescape(F.substring(x["t"], F.lit(1), x["m"]["chars"])))
