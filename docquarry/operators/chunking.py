"""Chunkers. A text never leaves its row until its pieces are cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import fixed
from docquarry.functions.text import (
    SPACE, clean_ocr, combine_blocks, density_route, is_blank, let, lines, strip, telling_description, text_density,
    timestamp_location, unroll,
)


RUN = 128


def text_blocks(c: Column, size: int) -> Column:
    """The text as fixed-size blocks, cut in one pass.

    Later substrings then touch two blocks at most; taking them from the whole
    text would walk it from the start each time.
    """
    return F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def piece(blocks: Column, size: int, start: Column, length: Column) -> Column:
    """``length <= size`` characters from 0-based ``start``."""
    i = F.floor(start / size).cast("int")
    near = F.concat(F.get(blocks, i), F.coalesce(F.get(blocks, i + 1), F.lit("")))
    return F.substr(near, (start - i * size + 1).cast("int"), length.cast("int"))


def chunk_bounds(blocks: Column, n: Column, size: int, overlap: int) -> Column:
    """``array<struct<start,end>>`` of newline-aligned overlapping chunks.

    A chunk ends after the last line end within its last fifth, or at ``size``.
    The next one starts ``overlap`` characters before that end (half a chunk
    further if this would not advance), moved behind the first line end within
    200 characters. Every step advances by at least half a chunk, which bounds
    the fold.
    """
    tail, look = int(size * 0.8), 200
    state_type = "struct<pos:int,out:array<struct<start:int,end:int>>>"

    def step(acc: Column, _: Column) -> Column:
        start = acc["pos"]

        def with_end(end0: Column) -> Column:
            window = piece(blocks, size, start + tail, end0 - start - tail)
            back = F.instr(F.reverse(window), "\n")
            end = F.when((end0 < n) & (back > 0), end0 - back + 1).otherwise(end0)

            def with_next(e: Column) -> Column:
                nxt0 = F.when(e - overlap <= start, start + size // 2).otherwise(e - overlap)

                def align(x: Column) -> Column:
                    ahead = F.instr(piece(blocks, size, x, F.lit(look)), "\n")
                    pos = F.when((x < n) & (ahead > 0), x + ahead).otherwise(x)
                    return F.struct(
                        pos.cast("int").alias("pos"),
                        F.concat(acc["out"], F.array(F.struct(
                            start.cast("int").alias("start"), e.cast("int").alias("end")))).alias("out"))

                return let(nxt0, align)

            return let(end, with_next)

        return F.when(start >= n, acc).otherwise(let(F.least(start + size, n), with_end))

    # a fold copies the array it appends to, so runs of steps are folded on their own and put together at the end
    total = F.ceil(n / (size // 2)).cast("int") + 3
    runs = F.sequence(F.lit(1), F.ceil(total / RUN).cast("int"))
    inner = F.sequence(F.lit(1), F.least(total, F.lit(RUN)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    outer_type = "struct<pos:int,outs:array<array<struct<start:int,end:int>>>>"

    def run(acc: Column, _: Column) -> Column:
        start = F.struct(acc["pos"].alias("pos"), none.alias("out")).cast(state_type)
        return F.aggregate(inner, start, step, lambda r: F.struct(
            r["pos"].alias("pos"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")).cast(outer_type))

    zero = F.struct(F.lit(0).alias("pos"), F.array().alias("outs")).cast(outer_type)
    return F.aggregate(runs, zero, run, lambda acc: F.flatten(acc["outs"]))


def with_text_pieces(df: DataFrame, text: str, out: str = "pieces", *, size: int = fixed.CHUNK_CHARS,
                     overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Replace a text column by the array of its non-blank chunks; null stays null."""
    keep = [c for c in df.columns if c != text]
    cut = df.select(*keep, text_blocks(F.col(text), size).alias("_blocks"), F.length(text).alias("_n"))
    bounded = cut.select(*keep, "_blocks", chunk_bounds(F.col("_blocks"), F.col("_n"), size, overlap).alias("_bounds"))
    pieces = F.filter(
        F.transform("_bounds", lambda b: piece(F.col("_blocks"), size, b["start"], b["end"] - b["start"])),
        lambda p: ~is_blank(p))
    return bounded.select(*keep, pieces.alias(out))


def chunk_text(df: DataFrame, text: str = "text", *, size: int = fixed.CHUNK_CHARS,
               overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: the input columns without the text, ``section`` and ``content``.

    Blank chunks are dropped before sections are numbered.
    """
    keep = [c for c in df.columns if c != text]
    cut = with_text_pieces(df, text, "_pieces", size=size, overlap=overlap)
    return unroll(cut, F.col("_pieces"), "section", "content", keep).withColumn("section", F.col("section") + 1)


_BLOCK_START = (
    rf"^{SPACE}*(?:class{SPACE}+|def{SPACE}+|async{SPACE}+def{SPACE}+|function{SPACE}+|func{SPACE}+"
    rf"|struct{SPACE}+|interface{SPACE}+)"
)


def with_code_pieces(df: DataFrame, text: str, out: str = "pieces", *, min_lines: int = fixed.CODE_MIN_LINES,
                     max_lines: int = fixed.CODE_MAX_LINES) -> DataFrame:
    """Replace a code column by the array of its non-blank blocks; null stays null.

    A definition opens a new block once the current one has ``min_lines``
    lines; ``max_lines`` lines close it in any case. Only the first lines of
    blocks are folded; the blocks are slices between them.
    """
    keep = [c for c in df.columns if c != text]
    split = df.select(*keep, F.when(F.col(text).isNotNull(), lines(F.col(text))).alias("_lines"))
    marked = split.select(*keep, "_lines", F.transform("_lines", lambda l: l.rlike(_BLOCK_START)).alias("_defs"))
    state_type = "struct<i:int,held:int,starts:array<int>>"

    def step(acc: Column, is_def: Column) -> Column:
        fresh = (acc["held"] == 0) | (is_def & (acc["held"] >= min_lines))
        held = F.when(fresh, F.lit(1)).otherwise(acc["held"] + 1)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(held >= max_lines, F.lit(0)).otherwise(held).alias("held"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts")).cast(state_type)
    starts = marked.select(*keep, "_lines", F.aggregate("_defs", zero, step, lambda a: a["starts"]).alias("_starts"))

    def block(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1), F.size("_lines"))
        return F.array_join(F.slice("_lines", s + 1, end - s), "\n")

    return starts.select(*keep, F.filter(F.transform("_starts", block), lambda b: ~is_blank(b)).alias(out))


def chunk_code(df: DataFrame, text: str = "text", *, min_lines: int = fixed.CODE_MIN_LINES,
               max_lines: int = fixed.CODE_MAX_LINES) -> DataFrame:
    """One row per block of code: ``block`` and ``content``."""
    keep = [c for c in df.columns if c != text]
    cut = with_code_pieces(df, text, "_pieces", min_lines=min_lines, max_lines=max_lines)
    return unroll(cut, F.col("_pieces"), "block", "content", keep).withColumn("block", F.col("block") + 1)


def transcript_chunks(segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(source, start, end, text)`` in seconds to located chunks; empty texts dropped. ``keep``: further columns."""
    t = segments.withColumn("content", strip(F.col("text"))).filter(F.col("content") != "")
    return t.select(*keep, "source", timestamp_location(F.col("start"), F.col("end")).alias("location"), "content")


def thread_chunks(messages: DataFrame, *, limit: int = fixed.THREAD_MAX_CHARS,
                  size: int = fixed.THREAD_PIECE_CHARS, span: int = 10_000) -> DataFrame:
    """Messages of a thread as one text; texts beyond ``limit`` are cut into pieces of ``size``.

    ``messages``: ``thread_id, seq, author, channel, sent, body``. Each piece
    carries a header with channel, first author and date. Threads are put
    together piecewise: a message's place in the thread text follows from the
    length of those before it, summed first over spans of ``span`` sequence
    numbers and then within a span. A piece gathers at most ``size`` characters,
    so even a huge thread is never held by one row or sorted by one task.
    """
    line = messages.withColumn("_text", F.concat("author", F.lit(": "), "body", F.lit("\n"))).withColumn(
        "_len", F.length("_text")).withColumn("_span", F.floor(F.col("seq") / span))
    spans = line.groupBy("thread_id", "_span").agg(
        F.sum("_len").alias("n"), F.min(F.struct("seq", "channel", "author", "sent")).alias("h"))
    whole = Window.partitionBy("thread_id")
    offsets = spans.select(
        "thread_id", "_span",
        (F.sum("n").over(whole.orderBy("_span")) - F.col("n")).alias("_base"),
        F.sum("n").over(whole).alias("_total"), F.min("h").over(whole).alias("_head"))
    inner = Window.partitionBy("thread_id", "_span").orderBy("seq")
    placed = line.join(offsets, ["thread_id", "_span"]).withColumn(
        "_from", F.col("_base") + F.sum("_len").over(inner) - F.col("_len"))
    unit = F.when(F.col("_total") > limit, F.lit(size)).otherwise(F.lit(limit)).cast("bigint")
    cut = placed.withColumn("_unit", unit).withColumn(
        "piece", F.explode(F.sequence(
            F.floor(F.col("_from") / F.col("_unit")),
            F.floor((F.col("_from") + F.col("_len") - 1) / F.col("_unit")))))
    begin = F.greatest(F.col("piece") * F.col("_unit"), F.col("_from"))
    stop = F.least((F.col("piece") + 1) * F.col("_unit"), F.col("_from") + F.col("_len"))
    part = F.substr("_text", (begin - F.col("_from") + 1).cast("int"), (stop - begin).cast("int"))
    head = F.concat(F.lit("["), F.col("h.channel"), F.lit(" / "), F.col("h.author"), F.lit(" / "), F.col("h.sent"), F.lit("]\n"))
    return (
        cut.withColumn("_part", part)
        .groupBy("thread_id", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "_part"))).alias("parts"), F.min("_head").alias("h"))
        .select("thread_id", (F.col("piece") + 1).alias("piece"),
                F.concat(head, F.array_join(F.transform("parts", lambda p: p["_part"]), "")).alias("content")))


def mail_chunk(sender: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Email from: "), sender, F.lit("\nSubject: "), subject, F.lit("\n\n"), body)


# --- front matter ------------------------------------------------------------------

_FRONT = rf"(?s)\A---{SPACE}*\n(.*?)\n---{SPACE}*\n"


def _list_of(header: Column, key: str) -> Column:
    inner = F.regexp_extract(header, rf"(?m)^[ \t]+{key}:[ \t]*\[([^\]\n]*)\]", 1)
    block = F.regexp_extract(header, rf"(?m)^[ \t]+{key}:[ \t]*\n((?:[ \t]+-[ \t]*[^\n]*(?:\n|\z))+)", 1)
    flow = F.split(inner, ",")
    dash = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+-[ \t]*([^\n]*)$"), F.lit(1))
    items = F.when(strip(inner) != "", flow).when(block != "", dash).otherwise(F.array().cast("array<string>"))
    return F.transform(items, lambda x: F.regexp_replace(strip(x), r"""^(['"])(.*)\1$""", "$2"))


def front_matter(text: Column) -> Column:
    """Split Markdown into permissions and body: ``struct<permissions, body>``.

    Reads the common YAML forms of a permission block: scalar, flow list,
    dashed list. A text without a header, or a header without the block, has
    no permissions.
    """
    def of(p: Column) -> Column:
        section = F.regexp_extract(F.concat(p["header"], F.lit("\n")),
                                   rf"(?m)^{fixed.PERMISSIONS_KEY}:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z))+)", 1)
        visibility = F.lower(F.regexp_replace(strip(F.regexp_extract(
            section, r"(?m)^[ \t]+visibility:[ \t]*([^\n#]*)", 1)), r"""^(['"])(.*)\1$""", "$2"))
        permissions = F.when(section != "", F.struct(
            F.when(visibility != "", visibility).otherwise("public").alias("visibility"),
            _list_of(section, "groups").alias("groups"),
            _list_of(section, "users").alias("users")))
        return F.struct(permissions.alias("permissions"), p["body"].alias("body"))

    has = text.rlike(_FRONT)
    split = let(F.struct(
        F.when(has, F.regexp_extract(text, _FRONT, 1)).otherwise("").alias("header"),
        F.when(has, F.regexp_replace(text, _FRONT, "")).otherwise(text).alias("body")), of)
    # most texts do not open with a header; a look at their start spares them the patterns
    return F.when(F.startswith(text, F.lit("---")), split).otherwise(F.struct(
        F.lit(None).cast("struct<visibility:string,groups:array<string>,users:array<string>>").alias("permissions"), text.alias("body")))


# --- media ------------------------------------------------------------------------------

def image_chunks(images: DataFrame, placeholder_model: str = "vision", keep: tuple[str, ...] = ()) -> DataFrame:
    """Route images by text density and put their texts together.

    ``images``: ``source, page, image, chars, width, height, confidence, ocr,
    description``. An image without any text keeps a placeholder chunk.
    """
    area = F.col("width") * F.col("height")
    routed = images.withColumn("content_type", density_route(text_density(F.col("chars"), area), F.col("confidence")))
    texts = routed.withColumn("_ocr", clean_ocr(F.col("ocr"))).withColumn("_seen", telling_description(F.col("description")))
    content = (
        F.when(F.col("content_type") == "image_ocr", F.col("_ocr"))
        .when(F.col("content_type") == "image_hybrid", combine_blocks(F.col("_ocr"), F.col("_seen")))
        .otherwise(F.col("_seen")))
    empty = F.concat(
        F.lit("["), F.col("source"), F.lit("]: no text could be extracted from this image; neither the OCR nor the "
                                           f"{placeholder_model} model returned content. Indexed as a placeholder."))
    location = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"), F.lit(", Image "), (F.col("image") + 1).cast("string"))
    done = texts.withColumn("_text", content)
    return done.select(
        *keep, "source", location.alias("location"),
        F.when(F.col("_text") != "", F.col("_text")).otherwise(empty).alias("content"),
        F.when(F.col("_text") != "", F.col("content_type")).otherwise("image_empty").alias("content_type"))
