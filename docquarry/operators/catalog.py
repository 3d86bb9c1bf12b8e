"""Inventory, lookups and scoping over the chunk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import fixed
from docquarry.functions.text import file_name
from docquarry.operators import scoring
from docquarry.session import persist_table


# --- scope -------------------------------------------------------------------------

def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; on tables partitioned by tenant this prunes folders."""
    return df.filter(F.col("tenant_id") == tenant)


def assert_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """Fails when a row to be written belongs to another tenant."""
    guard = F.when(F.col("tenant_id") == tenant, F.col("tenant_id")).otherwise(
        F.raise_error(F.lit("row of another tenant")))
    return df.withColumn("tenant_id", guard)


def acl_visible(df: DataFrame, user: str) -> DataFrame:
    """Rows with the index's permissions (``visibility, groups, users``) that ``user`` may read.

    Public rows (also those without permissions), rows shared with the user, rows
    shared with the user's mail domain.
    """
    domain = user.split("@")[-1]
    shared = F.array_contains("users", user), F.array_contains("groups", domain)
    return df.filter((F.coalesce("visibility", F.lit("public")) == "public") | F.coalesce(shared[0], F.lit(False)) | F.coalesce(shared[1], F.lit(False)))


def with_grants(chunks: DataFrame) -> DataFrame:
    """Chunks with ``grants``, whom their permissions let read them: ``*`` (everyone), ``u:`` users, ``g:`` mail domains."""
    def named(prefix: str, names: str) -> Column:
        return F.coalesce(F.transform(names, lambda n: F.concat(F.lit(prefix), n)), F.array().cast("array<string>"))

    public = F.coalesce("visibility", F.lit("public")) == "public"
    shared = F.filter(F.concat(named("u:", "users"), named("g:", "groups")), lambda g: g.isNotNull())
    return chunks.withColumn("grants", F.when(public, F.array(F.lit("*"))).otherwise(shared))


def with_principals(questions: DataFrame, user: str = "user") -> DataFrame:
    """Questions with ``principals``, what the asking user may present: everyone's, their own, their mail domain's.

    Retrieval of such questions over chunks ``with_grants`` scores nothing that the user may not read.
    """
    own = F.array(F.concat(F.lit("u:"), user), F.concat(F.lit("g:"), F.regexp_extract(user, "[^@]*$", 0)))
    return questions.withColumn("principals", F.array_compact(F.concat(F.array(F.lit("*")), own)))


# --- inventory ------------------------------------------------------------------------

def inventory(chunks: DataFrame) -> DataFrame:
    """Chunk count and last write per file, in no order."""
    return chunks.groupBy("source", "category").agg(
        F.count("*").alias("chunks"), F.max("created_at").alias("last_ingested"))


def list_files(chunks: DataFrame, category: str | None = None) -> DataFrame:
    """Chunk count and last write per file."""
    files = inventory(chunks if category is None else chunks.filter(F.col("category") == category))
    order = [F.col("last_ingested").desc(), "source"]
    return files.orderBy(*(["category"] if category is None else []), *order)


def index_status(chunks: DataFrame) -> DataFrame:
    """Chunk and source totals; rows fold to one per source before they are counted."""
    return chunks.groupBy("source").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("sources"))


def chunks_by_type(chunks: DataFrame) -> DataFrame:
    """Counts per source type with a total line."""
    return chunks.rollup("source_type").agg(F.count("*").alias("chunks")).select(
        F.coalesce("source_type", F.lit("total")).alias("source_type"), "chunks")


def chunk_preview(chunks: DataFrame, chars: int = 120) -> DataFrame:
    return chunks.select("id", "source", F.substring("content", 1, chars).alias("preview"), F.length("content").alias("n_chars"))


# --- lookups ------------------------------------------------------------------------------

def _file_key(source: Column) -> Column:
    return F.lower(F.ltrim(file_name(source), F.lit("/")))


def files_of(chunks: DataFrame) -> DataFrame:
    """One row per source: its lowest chunk id and its lower-case file name."""
    return chunks.groupBy("source").agg(F.min("id").alias("id")).select(
        F.col("source").alias("f_source"), "id", F.lower(file_name(F.col("source"))).alias("_file"))


def by_suffix(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose source ends with the requested file name, ignoring case.

    A requested name has no slash, so it must end the source's own file name:
    an equality on one of that name's suffixes.
    """
    want = requests.select("request_id", _file_key(F.col("source")).alias("_want")).filter(F.length("_want") > 0)
    ends = files.filter(F.length("_file") > 0).withColumn(
        "_want", F.explode(F.transform(F.sequence(F.lit(1), F.length("_file")), lambda i: F.right("_file", i))))
    return ends.join(want, "_want").drop("_want", "_file")


def pick_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(request_id, stage, id)``: the chunk that answers each request, if any.

    Stage 1 the exact source and location, stage 2 a source that ends with the
    requested file name; the lowest id within a stage. Works on ids and names only.
    """
    r = requests.select("request_id", "source", "location")
    exact = chunks.select("id", "source", "location").join(r, ["source", "location"]).select(
        "request_id", F.lit(1).alias("stage"), "id")
    fuzzy = by_suffix(r, files_of(chunks)).select("request_id", F.lit(2).alias("stage"), "id")
    return exact.unionByName(fuzzy).groupBy("request_id").agg(F.min(F.struct("stage", "id")).alias("p")).select(
        "request_id", "p.stage", "p.id")


def read_chunk(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(request_id, source, location)`` to one chunk each; ``found`` is false without one."""
    picks = persist_table(pick_chunks(requests, chunks), "picks")
    texts = chunks.select("id", "source", "location", "content", "category").join(picks, "id")
    return requests.select("request_id").join(texts, "request_id", "left").select(
        "request_id", F.col("id").isNotNull().alias("found"), "stage", "id", "source", "location", "content", "category")


def compare_sections(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(request_id, source_a, location_a, source_b, location_b)`` to both chunks, side by side."""
    sides = requests.select("request_id", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("source_a").alias("source"), F.col("location_a").alias("location")),
        F.struct(F.lit("b").alias("side"), F.col("source_b").alias("source"), F.col("location_b").alias("location")),
    )).alias("s")).select(F.struct("request_id", "s.side").alias("request_id"), "s.source", "s.location")
    got = read_chunk(sides, chunks)

    def side(name: str, field: str) -> Column:
        return F.max(F.when(F.col("request_id.side") == name, F.col(field))).alias(f"{field}_{name}")

    return got.groupBy(F.col("request_id.request_id").alias("request_id")).agg(
        *[side(n, f) for n in ("a", "b") for f in ("source", "location", "content")])


def document_sections(chunks: DataFrame) -> DataFrame:
    """First row per source and location; ``id`` gives the order within a source."""
    return chunks.groupBy("source", "location").agg(F.min("id").alias("id"), F.min_by("content", "id").alias("content"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


COMMON = 200  # files; a token of more files than these is met by sets of tokens, not by pairs


def best_by_tokens(requests: DataFrame, named: DataFrame, common: int = COMMON) -> DataFrame:
    """``(request_id, id)``: the row of ``named`` (id, tokens) that shares most tokens with each request
    (request_id, tokens), at least one; the lowest id among equals.

    A rare token pairs its requests with ``common`` files at most, and these pairs are counted in full. Common tokens
    would pair everything, so equal sets of them fold to one, a set of files standing for its lowest id, and sets meet
    sets. A file found by its common tokens alone counts with those; where it has rare ones too, its pair says more.
    """
    each = named.select("id", F.explode("tokens").alias("token"))
    known = each.groupBy("token").agg((F.count("*") > common).alias("often"))
    have = persist_table(each.join(known, "token"), "named")
    want = persist_table(requests.select("request_id", F.explode("tokens").alias("token")).join(known, "token"), "wanted")

    def often(df: DataFrame, key: str) -> DataFrame:
        return df.filter("often").groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("tokens"))

    many, asked = often(have, "id"), often(want, "request_id")
    pairs = want.filter("NOT often").select("request_id", "token").join(have.filter("NOT often").select("id", "token"), "token")
    pairs = pairs.groupBy("request_id", "id").agg(F.count("*").alias("rare"))
    pairs = pairs.join(asked, "request_id", "left").join(many.withColumnRenamed("tokens", "theirs"), "id", "left")
    by_rare = pairs.select("request_id", "id", (F.col("rare") + F.coalesce(F.size(F.array_intersect("tokens", "theirs")), F.lit(0))).alias("score"))
    asked = asked.withColumn("query_id", F.array_join("tokens", " "))
    sets = scoring.best_k(scoring.TokenBlock, asked.select("query_id", "tokens").distinct(), many.groupBy("tokens").agg(F.min("id").alias("id")), 1)
    by_often = asked.join(sets.filter(F.col("score") >= 1), "query_id").select("request_id", "id", F.col("score").cast("bigint").alias("score"))
    return by_rare.unionByName(by_often).groupBy("request_id").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"))


def resolve_document(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(request_id, source)`` to the best fitting indexed source.

    Stage 1 the source itself; stage 2 a source that ends with the requested
    name as ``.md`` (lowest id first); stage 3, for what is left, the source whose
    file name shares most tokens with the request, at least one.
    """
    # several steps below use the file list: one pass over the chunk table makes it
    files = persist_table(files_of(chunks), "files")
    r = requests.select("request_id", "source")
    exact = files.join(r, F.col("source") == F.col("f_source")).select("request_id", F.lit(1).alias("stage"), "id")
    as_md = r.withColumn("source", F.concat(
        F.regexp_replace(F.ltrim(file_name(F.col("source")), F.lit("/")), r"\.md$", ""), F.lit(".md"))).filter("source <> '.md'")
    suffix = by_suffix(as_md, files).select("request_id", F.lit(2).alias("stage"), "id")
    first = exact.unionByName(suffix).groupBy("request_id").agg(F.min(F.struct("stage", "id")).alias("p"))
    first = persist_table(first.select("request_id", "p.stage", "p.id"), "picks")
    left = r.join(first, "request_id", "left_anti").select("request_id", _tokens(F.lower("source")).alias("tokens"))
    named = files.select("id", _tokens(F.regexp_replace("_file", r"\.md$", "")).alias("tokens"))
    near = best_by_tokens(left, named).select("request_id", F.lit(3).alias("stage"), "id")
    picked = files.select("id", "f_source").join(first.unionByName(near), "id")
    return r.join(picked, "request_id", "left").select(
        "request_id", F.col("source").alias("requested"), F.col("f_source").alias("source"), "stage")


def contact_of(users: DataFrame, members: DataFrame, default: str | None = None) -> DataFrame:
    """The address to name in refusals: an admin by either JSON column, else a member, else ``default``."""
    role = F.coalesce(
        F.get_json_object("raw_user_meta_data", "$.role") == "admin", F.lit(False)) | F.coalesce(
        F.get_json_object("raw_app_meta_data", "$.role") == "admin", F.lit(False))
    staged = users.filter(role).select("email", F.lit(1).alias("stage"), "id").unionByName(
        members.select("email", F.lit(2).alias("stage"), "id"))
    return staged.agg(F.min_by("email", F.struct("stage", "id")).alias("email")).select(
        F.coalesce("email", F.lit(default)).alias("email"))


# --- logs -------------------------------------------------------------------------------------

def recent_status(log: DataFrame, keep: int = fixed.STATUS_KEEP, errors_only: bool = False) -> DataFrame:
    rows = log.filter(F.col("error").isNotNull()) if errors_only else log
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(keep)
