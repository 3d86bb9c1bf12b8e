"""Column expressions over text.

Everything here stays on the JVM side. Patterns spell out Unicode word
characters and white space, so that results do not depend on the Java version
and agree with SQL engines whose classes are ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed

WORD = r"\p{L}\p{N}_"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]
_LINE_END = r"[\n\x0b\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_IN_LINE_SPACE = r"[\t\x{1f}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"  # white space that ends no line
EDGE_START = rf"(?<![{WORD}])"
EDGE_END = rf"(?![{WORD}])"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
STRIP_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
MARK = "\x01"  # joins pieces that are split again in the same expression


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unroll(df: DataFrame, items: Column, pos: str, item: str, keep: list[str | Column]) -> DataFrame:
    """One row per array item, with its place from 0.

    A plain explode makes the optimizer put a "has items" filter below it, which
    evaluates the whole array expression a second time, with every column it was
    built from expanded in place. The outer form, filtered afterwards, does not.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_CHARS))


def is_blank(c: Column) -> Column:
    # trimmed at the left only, which stops at the first other character; at the right the whole text is walked
    return F.ltrim(F.coalesce(c, F.lit("")), F.lit(STRIP_CHARS)) == ""


def any_match(c: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    flag = "(?i)" if ignore_case else ""
    return c.rlike(flag + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def lines(c: Column) -> Column:
    """Split at every line end; a final line end opens no extra line."""
    return let(F.split(c, rf"\r\n|{_LINE_END}", -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def words(c: Column) -> Column:
    """Runs of word characters, in order, duplicates kept."""
    return F.regexp_extract_all(c, F.lit(rf"([{WORD}]+)"), F.lit(1))


def split_space(c: Column) -> Column:
    """Split at white space without empty pieces."""
    return F.regexp_extract_all(c, F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def truncate(c: Column, limit: int | Column) -> Column:
    """First ``limit`` characters, marked when something was cut."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), n), F.lit(fixed.ELLIPSIS))).otherwise(c)


# --- keywords -------------------------------------------------------------

def keywords(c: Column, stopwords: list[str] = fixed.ROUTE_STOPWORDS) -> Column:
    """Lower-case words minus stop words; order and duplicates kept."""
    return F.filter(words(F.lower(c)), lambda w: ~w.isin(stopwords))


def with_prefix(c: Column, role: str) -> Column:
    """Task prefix that embedding models expect; ``role`` is query or document."""
    return F.concat(F.lit({"query": "search_query: ", "document": "search_document: "}[role]), c)


# --- keys and routes --------------------------------------------------------

def category_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", 1)).otherwise(
        F.lit(fixed.DEFAULT_CATEGORY))


def file_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def extension_of(key: Column) -> Column:
    """Lower-case suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(key), r"^\.*[^.].*(\.[^.]+)$", 1))


def stem_of(source: Column) -> Column:
    """Lower-case file name without its last suffix."""
    return F.lower(F.regexp_replace(file_name(source), r"^(\.*[^.].*)\.[^.]*$", "$1"))


def is_allowed(key: Column) -> Column:
    return extension_of(key).isin(fixed.ALLOWED_EXTS)


def handler_of(key: Column) -> Column:
    ext = extension_of(key)
    return (
        F.when(ext.isin(fixed.CODE_EXTS), "code")
        .when(ext.isin(fixed.TEXT_EXTS), "document")
        .when(ext.isin(fixed.OFFICE_EXTS), "paged")
        .when(ext.isin(fixed.IMAGE_EXTS), "image")
        .when(ext.isin(fixed.VIDEO_EXTS), "video")
        .when(ext.isin(fixed.AUDIO_EXTS), "audio")
        .otherwise("unsupported")
    )


def source_uri(key: Column, bucket: str | None = None) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/" if bucket else "local://"), key)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def object_hash(etag: Column, content: Column) -> Column:
    """The etag of a single-part upload is its MD5; multi-part etags carry a dash."""
    return F.when(F.contains(etag, F.lit("-")), F.sha2(content, 256)).otherwise(etag)


# --- scrubbing ------------------------------------------------------------------

_SECRET = fixed.SECRET_PATTERN.replace("%s", SPACE)
_SECRET_KEEP = _SECRET.replace("(key|secret|token|password|auth)" + SPACE + "*",
                               "((?:key|secret|token|password|auth)" + SPACE + "*)")


# the same matches as the plain pattern, but a long run without an at sign is walked
# once: a match can only start where such a run or the previous match ended
_EMAIL = r"(?:(?<![a-zA-Z0-9_.+-])|\G)" + fixed.EMAIL_PATTERN.replace("]+@", "]++@", 1)


def _scrub_keys(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("A")), F.regexp_replace(c, fixed.CLOUD_KEY_PATTERN, fixed.CLOUD_KEY_TAG)).otherwise(c)


def _scrub_secrets(c: Column) -> Column:
    quoted = F.contains(c, F.lit('"')) | F.contains(c, F.lit("'"))
    assigned = F.contains(c, F.lit(":")) | F.contains(c, F.lit("="))
    return F.when(quoted & assigned, F.regexp_replace(c, _SECRET_KEEP, f'$1: "{fixed.SECRET_TAG}"')).otherwise(c)


def _scrub_mail(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, _EMAIL, fixed.EMAIL_TAG)).otherwise(c)


def scrub(c: Column) -> Column:
    """Replace cloud keys, then quoted secrets, then e-mail addresses by tags.

    Most texts hold none of them; a look for the one sign that each pattern needs
    spares them the pattern.
    """
    return let(let(_scrub_keys(c), _scrub_secrets), _scrub_mail)


def redactions(c: Column) -> dict[str, Column]:
    """How often :func:`scrub` replaces, by kind."""
    return {
        "cloud_keys": F.regexp_count(c, F.lit(fixed.CLOUD_KEY_PATTERN)),
        "secrets": F.regexp_count(c, F.lit(_SECRET)),
        "emails": F.regexp_count(let(_scrub_keys(c), _scrub_secrets), F.lit(_EMAIL)),
    }


# --- citations --------------------------------------------------------------------

_CITE = rf"(?i)\[Cit(?:ation|e)?:{SPACE}*[^\]]+\]"
_CITE_PARTS = (
    rf"(?i)\[Cit(?:ation|e)?:{SPACE}*([^,)|{SPACE[1:]}+){SPACE}*"
    rf"(?:,{SPACE}*|\({SPACE}*|\|{SPACE}*(?:Location:{SPACE}*)?)([^)\]]+?){SPACE}*\)?\]"
)


def strip_citations(c: Column) -> Column:
    return strip(F.regexp_replace(c, _CITE, ""))


def strip_footers(c: Column) -> Column:
    """Remove every citation footer form a model may write, leaving a space."""
    for pattern in (
        rf"(?i)\[Citation:{SPACE}*[^\]]+\]",
        rf"(?i)\[(?:Source|Location):{SPACE}*[^\]]+\]",
        r"\[\p{Nd}+\]",
        rf"(?i)\[(?:Source|Citation){SPACE}*[^\]]*\]",
    ):
        c = F.regexp_replace(c, pattern, " ")
    return strip(c)


def citations(c: Column) -> Column:
    """``array<struct<source,location>>`` in order of appearance."""
    src = F.regexp_extract_all(c, F.lit(_CITE_PARTS), F.lit(1))
    loc = F.regexp_extract_all(c, F.lit(_CITE_PARTS), F.lit(2))
    return F.zip_with(src, loc, lambda s, l: F.struct(
        strip(s).alias("source"), strip(F.rtrim(strip(l), F.lit(")"))).alias("location")))


def cited_names(c: Column) -> Column:
    """Source names of ``[Citation: name…]`` marks, also when the location is missing."""
    found = F.regexp_extract_all(c, F.lit(rf"(?i)\[Citation:{SPACE}*([^\]|,]+)"), F.lit(1))
    return F.transform(found, strip)


def source_key(source: Column) -> Column:
    """What two source names are compared on: lower case, up to the first dot."""
    return F.substring_index(F.lower(source), ".", 1)


def same_source(a: Column, b: Column) -> Column:
    return F.contains(source_key(a), source_key(b)) | F.contains(source_key(b), source_key(a))


def rewrite_endnotes(c: Column) -> Column:
    """Turn ``[n] source: X, location: Y`` end notes into inline citations."""
    note = rf"(?imd)^\[(\p{{Nd}}+)\]{SPACE}*source:{SPACE}*([^,\n]+),{SPACE}*location:{SPACE}*(.+)$"

    def grab(i: int) -> Column:
        return F.regexp_extract_all(c, F.lit(note), F.lit(i))

    notes = F.arrays_zip(grab(1).alias("n"), grab(2).alias("s"), grab(3).alias("l"))

    def rewrite(pair: Column) -> Column:
        num, mark = pair["num"], pair["mark"]
        body = strip(F.regexp_replace(c, note, ""))

        def inline(ref: Column) -> Column:
            # the last note of a number counts
            pos = F.size(num) - F.array_position(F.reverse(num), ref) + 1
            return F.when(F.array_contains(num, ref), F.concat(F.lit(" "), F.get(mark, (pos - 1).cast("int")))).otherwise(
                F.concat(F.lit("["), ref, F.lit("]")))

        def replace_refs(b: Column) -> Column:
            pieces = F.split(b, r"\[\p{Nd}+\]", -1)
            refs = F.regexp_extract_all(b, F.lit(r"\[(\p{Nd}+)\]"), F.lit(1))
            return F.array_join(
                F.transform(pieces, lambda p, i: F.concat(
                    p, F.when(i < F.size(refs), inline(F.get(refs, i))).otherwise(F.lit("")))), "")

        def back_fill(b: Column) -> Column:
            single = (F.size(F.array_distinct(num)) == 1) & ~F.contains(b, F.lit("[Citation:"))
            filled = F.replace(
                F.regexp_replace(b, rf"([.!?])({SPACE}+|\z)", f"{MARK}$1$2"),
                F.lit(MARK), F.concat(F.lit(" "), F.element_at(mark, -1)))
            return F.when(single, filled).otherwise(b)

        return let(let(body, replace_refs), back_fill)

    return let(notes, lambda ns: F.when(F.size(ns) == 0, c).otherwise(let(
        F.struct(
            F.transform(ns, lambda x: x["n"]).alias("num"),
            F.transform(ns, lambda x: F.concat(
                F.lit("[Citation: "), strip(x["s"]), F.lit(", "), strip(x["l"]), F.lit("]"))).alias("mark")),
        rewrite)))


# --- sentences -----------------------------------------------------------------------

_NO_BREAK_AFTER = (
    rf"^\p{{Lu}}\.*$|^\p{{Nd}}+\.*$|(?i)(?:^|[^{WORD}])(?:{'|'.join(fixed.ABBREVIATIONS)})\.$"
)


# starts at word starts only and never backs up, so a huge token is walked once
_LAST_WORD = f"(?<!{NOT_SPACE})({NOT_SPACE}++)$"


def sentences(c: Column) -> Column:
    """Sentences of each line; no break after initials, abbreviations, bare numbers.

    Whether a piece joins its predecessor depends on that predecessor's last
    word alone, so one pass marks the breaks and a split applies them.
    """

    def of_line(line: Column) -> Column:
        pieces = F.filter(
            F.split(F.regexp_replace(line, rf"([.!?]){SPACE}+", f"$1{MARK}"), MARK, -1),
            lambda p: strip(p) != "")
        joined = F.array_join(
            F.transform(pieces, lambda p: F.concat(
                p, F.when(F.regexp_extract(strip(p), _LAST_WORD, 1).rlike(_NO_BREAK_AFTER), " ")
                .otherwise(MARK))), "")
        return F.filter(F.transform(F.split(joined, MARK, -1), strip), lambda s: s != "")

    return F.flatten(F.transform(F.split(c, "\n", -1), of_line))


def sentence_core(s: Column) -> Column:
    """A sentence without citations and without its list bullet."""
    return strip(F.regexp_replace(strip_citations(s), rf"^[\-*\x{{2022}}\p{{Nd}}]+\.?{SPACE}*", ""))


def long_words(c: Column) -> Column:
    """Words of three characters or more, lower case, duplicates kept."""
    return F.filter(words(F.lower(c)), lambda w: F.length(w) >= 3)


def sentence_facts(sentence: Column) -> Column:
    """What :func:`supported_by` needs to know of a sentence, worked out once."""
    def of(core: Column) -> Column:
        return F.struct(
            F.lower(core).alias("text"),
            F.lower(strip(F.substring_index(core, ",", 1))).alias("head"),
            F.regexp_extract_all(
                core, F.lit(rf"{EDGE_START}(19[89]\p{{Nd}}|20[0-9]\p{{Nd}}){EDGE_END}"), F.lit(1)).alias("years"),
            long_words(core).alias("words"))

    return let(sentence_core(sentence), of)


def supported_by(facts: Column, hay: Column, share: float = 0.25) -> Column:
    """Is a sentence backed by the lower-case text ``hay``?

    Yes when the text or the part before its first comma occurs literally;
    otherwise every year it names must occur and at least ``max(2, share)`` of
    its longer words. An empty part before a leading comma occurs everywhere.
    """
    literal = F.contains(hay, facts["text"]) | F.contains(hay, facts["head"])
    return supported_with(facts, literal, lambda y: F.contains(hay, y), lambda w: F.contains(hay, w), share)


def supported_with(facts: Column, literal: Column, has_year: Callable[[Column], Column], has_word: Callable[[Column], Column],
                   share: float = 0.25) -> Column:
    """:func:`supported_by` where it is known already what of the sentence occurs."""
    hits = F.size(F.filter(facts["words"], has_word))
    return (
        F.when(facts["text"] == "", F.lit(False))
        .when(literal, F.lit(True))
        .when(~F.forall(facts["years"], has_year), F.lit(False))
        .otherwise(hits >= F.greatest(F.lit(2.0), F.size(facts["words"]) * F.lit(share)))
    )


def sentence_supported(sentence: Column, content: Column, share: float = 0.25) -> Column:
    return let(F.struct(sentence_facts(sentence).alias("f"), F.lower(content).alias("hay")),
               lambda p: supported_by(p["f"], p["hay"], share))


# --- claims ------------------------------------------------------------------------------

_CAPWORD = rf"[A-Z][a-z]{{2,}}(?:{SPACE}+[A-Z][a-z]{{2,}})?"
_CLAIM = (
    rf"{EDGE}(?:{'|'.join(fixed.CURRENCIES)}){EDGE}"
    rf"|{EDGE}\p{{Nd}}{{1,3}}(?:[.,]\p{{Nd}}+)?(?:%|x|×)?{EDGE}"
    rf"|{EDGE}\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}{EDGE}"
    rf"|{EDGE}(?:{'|'.join(fixed.MONTHS)})[a-z]*{EDGE}{SPACE}+\p{{Nd}}{{1,2}}(?:,{SPACE}*\p{{Nd}}{{4}})?"
    rf"|{EDGE}{_CAPWORD}{EDGE}"
)


def claim_kind(claim: Column) -> Column:
    return (
        F.when(claim.rlike(rf"^(?:{'|'.join(fixed.CURRENCIES)})$"), "currency")
        .when(claim.rlike(r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$"), "date")
        .when(claim.rlike(r"^\p{Nd}"), "number")
        .when(claim.rlike(r"\p{Nd}"), "month")
        .otherwise("name")
    )


def claims(answer: Column, own_names: tuple[str, ...] = ()) -> Column:
    """Checkable specifics in order: currencies, numbers, dates, names.

    ``own_names`` adds the deployment's own product names to the words that
    are not claims.
    """
    skip = fixed.CLAIM_STOPWORDS + [n.lower() for n in own_names]
    found = F.regexp_extract_all(answer, F.lit(f"({_CLAIM})"), F.lit(1))
    return F.filter(found, lambda x: ~F.lower(x).isin(skip))


def comparable(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "), F.lit(".,;:!?"))


def claim_supported(claim: Column, context: Column, context_is_comparable: bool = False) -> Column:
    """Does the claim, or a loose form of it, occur in the context?"""
    ctx = context if context_is_comparable else comparable(context)

    def judge(p: Column) -> Column:
        n, x = p["n"], p["x"]
        bare_of = strip(F.regexp_replace(n, rf"^(?:the|this|that|these|those|a|an){SPACE}+", ""))

        def by_form(m: Column) -> Column:
            bare = strip(F.regexp_replace(m, rf"[^{WORD}{SPACE[1:]}", ""))
            parts = split_space(m)
            last = F.element_at(parts, -1)
            tail = F.array_join(F.slice(parts, -2, 2), " ")
            number = F.regexp_extract(n, r"\p{Nd}+(?:[.,]\p{Nd}+)?", 0)
            return (
                (m == "")
                | F.contains(x, m)
                | F.contains(x, n)
                | ((bare != "") & F.contains(x, bare))
                | ((F.size(parts) >= 2) & (F.contains(x, tail) | ((F.length(last) > 3) & F.contains(x, last))))
                | ((number != "") & F.contains(x, number))
            )

        return (n == "") | let(bare_of, by_form)

    return let(F.struct(comparable(claim).alias("n"), ctx.alias("x")), judge)


# --- answer classes -----------------------------------------------------------------------------

def refused(answer: Column) -> Column:
    """The answer concedes that it has nothing (tool loop's rule)."""

    def judge(v: Column) -> Column:
        starts = F.lit(False)
        for p in fixed.REFUSAL_STARTS:
            starts = starts | v.startswith(p)
        return (v == "") | starts | any_match(
            F.substring(v, 1, fixed.REFUSAL_HEAD_CHARS), ["(?d)" + p for p in fixed.REFUSAL_HEAD_PATTERNS])

    return let(F.lower(strip(F.coalesce(answer, F.lit("")))), judge)


def eval_refused(answer: Column, n_citations: Column) -> Column:
    """The evaluation's rule: a refusal phrase, or a hedge without citations."""
    a = F.coalesce(answer, F.lit(""))
    return is_blank(a) | a.rlike("(?id)" + fixed.EVAL_REFUSAL_PATTERN) | (
        (F.coalesce(n_citations, F.lit(-1)) == 0) & a.rlike("(?i)" + fixed.EVAL_HEDGE_PATTERN))


def no_answer(answer: Column) -> Column:
    """The question route's rule, after grounding."""
    v = F.lower(answer)
    return (
        is_blank(answer)
        | F.contains(v, F.lit("i cannot find"))
        | F.contains(v, F.lit("i cannot answer"))
        | (F.contains(v, F.lit("i don")) & F.contains(v, F.lit("have"))
           & (F.contains(v, F.lit("indexed")) | F.contains(v, F.lit("document"))))
    )


def question_type(q: Column) -> Column:
    parts = [
        EDGE_START + text + (EDGE_END if closed else "")
        for text, closed in fixed.EXPLORATORY_WORDS
    ]
    return F.when(any_match(F.lower(q), parts), "exploratory").otherwise("factual")


def clean_answer(c: Column) -> Column:
    """Drop chat markers, fenced JSON and leaked tool calls from a model answer."""
    for pattern in (
        r"<\|/?tool_call\|>",
        r"<\|/?im_start\|>",
        r"<\|/?im_end\|>",
        r"(?s)<\|/?user\|>.*?(?=\n\n|\z)",
        r"<\|/?assistant\|>",
        rf"(?s)```json{SPACE}*\[.*?```",
        rf"(?s)```{SPACE}*\[.*?```",
        rf'\{{"results"{SPACE}*:{SPACE}*\[[^\]]*\]{SPACE}*\}}',
        rf'(?s)\{{"name"{SPACE}*:{SPACE}*"[^"]+"{SPACE}*,{SPACE}*"arguments"{SPACE}*:.*?\}}{SPACE}*\]',
    ):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


# --- media text ----------------------------------------------------------------------------------------

def clock(seconds: Column) -> Column:
    """``mm:ss``; minutes run past 59."""
    mins = F.floor(seconds / 60).cast("bigint")
    secs = F.floor(F.pmod(seconds, F.lit(60.0))).cast("bigint")

    def two(x: Column) -> Column:
        s = x.cast("string")
        return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)

    return F.concat(two(mins), F.lit(":"), two(secs))


def timestamp_location(start: Column, end: Column) -> Column:
    return F.concat(F.lit("Timestamp "), clock(start), F.lit(" - "), clock(end))


_LINE_GAP = rf"(?:(?<!{_IN_LINE_SPACE}){_IN_LINE_SPACE}++)?+{_LINE_END}{SPACE}*+"
_NOISE_LINE = rf"(?<![^\n])(?:[^\n]{{0,{fixed.OCR_LINE_CHARS - 1}}}+(?![^\n])|(?:{NOT_SPACE}++{_IN_LINE_SPACE}++){{0,{fixed.OCR_LINE_WORDS - 2}}}+{NOT_SPACE}++(?![^\n]))\n?+"


def clean_ocr(c: Column) -> Column:
    """Drop noise lines, then scrub.

    Two patterns over the whole text: one strips lines and drops blank ones, the other drops lines that are too short
    or have too few words. No line becomes a value of its own.
    """
    def drop(stripped: Column) -> Column:
        return F.rtrim(F.regexp_replace(stripped, _NOISE_LINE, ""), F.lit("\n"))

    return let(let(strip(F.regexp_replace(c, _LINE_GAP, "\n")), drop), scrub)


def telling_description(c: Column) -> Column:
    """The description, scrubbed, or '' when it has too few longer words."""
    n = F.size(F.filter(split_space(c), lambda w: F.length(w) > 3))
    return F.when(n >= fixed.MIN_DESCRIPTION_WORDS, scrub(c)).otherwise("")


def text_density(chars: Column, area: Column) -> Column:
    return F.least(F.lit(1.0), chars * F.lit(float(fixed.CHAR_PIXELS)) / F.greatest(area, F.lit(1)))


def density_route(density: Column, confidence: Column) -> Column:
    return (
        F.when((density >= fixed.HIGH_TEXT_DENSITY) & (confidence >= fixed.OCR_CONFIDENCE), "image_ocr")
        .when(density >= fixed.LOW_TEXT_DENSITY, "image_hybrid")
        .otherwise("image_vision")
    )


def combine_blocks(ocr: Column, vision: Column) -> Column:
    return F.concat_ws(
        "\n\n",
        F.when(ocr != "", F.concat(F.lit("[Text content]\n"), ocr)),
        F.when(vision != "", F.concat(F.lit("[Visual content]\n"), vision)),
    )


def scanned_page(text: Column, file_bytes: Column) -> Column:
    return (F.length(strip(text)) < fixed.SCANNED_MAX_CHARS) & (file_bytes / 1024 > fixed.SCANNED_MIN_KB)


# --- identifiers -------------------------------------------------------------------------------------------

def technique_ids(c: Column) -> Column:
    """Sorted distinct technique ids of five characters or more."""
    found = F.regexp_extract_all(c, F.lit(f"({fixed.TECHNIQUE_PATTERN})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 5)))


_SPECIFIC = (
    rf"(CVE-\p{{Nd}}{{4}}-\p{{Nd}}+|{fixed.TECHNIQUE_PATTERN}"
    rf"|{EDGE}(?:19|20)\p{{Nd}}{{2}}{EDGE}"
    rf"|\${SPACE}?\p{{Nd}}[\p{{Nd}},]*\.?\p{{Nd}}*{SPACE}?[KMB]?)"
)


def specifics(c: Column) -> Column:
    """CVE ids, technique ids, years and dollar amounts in order of appearance."""
    return F.regexp_extract_all(c, F.lit(_SPECIFIC), F.lit(1))


def unsupported_specifics(answer: Column, context: Column, question: Column) -> Column:
    def missing(p: Column) -> Column:
        return F.filter(specifics(answer), lambda t: ~F.contains(p["q"], F.lower(t)) & ~F.contains(p["c"], F.lower(t)))

    return let(F.struct(F.lower(F.coalesce(question, F.lit(""))).alias("q"),
                        F.lower(F.coalesce(context, F.lit(""))).alias("c")), missing)
