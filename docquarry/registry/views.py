"""Views of the driver's tables in the engine's own shapes.

Each view exists twice: as a DataFrame for the operators and as SQL common
table expressions for the checks. They cover whole tables; attributes such as
tenant, category or etag are derived from the row, so that every branch of
every operator occurs in the data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.buckets import Projections, fit_hashing, write_buckets
from docquarry.operators.postings import Postings, read_postings, write_postings
from docquarry.session import shared_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def _n_vectors(app_id: str, sf_dir: str) -> int:
    return SparkSession.getActiveSession().read.parquet(f"{sf_dir}/embeddings.parquet").count()


def n_vectors(spark: SparkSession, sf_dir: str) -> int:
    return _n_vectors(spark.sparkContext.applicationId, sf_dir)


# Expressions below are valid in Spark SQL and in the checking engine.
FILE_NO = "CAST(floor(doc_id / 3) AS BIGINT)"
CATEGORY = (
    f"CASE CAST({FILE_NO} % 5 AS INT) WHEN 0 THEN 'compliance' WHEN 1 THEN 'products' "
    "WHEN 2 THEN 'internal' WHEN 3 THEN 'multimedia' ELSE 'general' END"
)
SUFFIX = "CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.exe' ELSE '.py' END"
SOURCE_TYPE = (
    f"CASE WHEN CAST({FILE_NO} % 5 AS INT) <> 3 THEN 'document' "
    "WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'video' ELSE 'audio' END"
)
TENANT = "CASE WHEN lang = 'en' THEN 'tenant-a' ELSE 'tenant-b' END"


def _key(name: str) -> str:
    return f"CASE WHEN ({CATEGORY}) = 'general' THEN {name} ELSE concat({CATEGORY}, '/', {name}) END"


INDEX_COLUMNS = {
    "id": "doc_id",
    "tenant_id": TENANT,
    "source": f"concat('local://', {_key(f'''concat('doc-', CAST({FILE_NO} AS VARCHAR(20)), '.md')''')})",
    "source_type": SOURCE_TYPE,
    "location": "concat('Section ', CAST(doc_id % 3 + 1 AS VARCHAR(20)))",
    "content": "text",
    "file_hash": "md5(text)",
    "category": CATEGORY,
}

INDEX_SQL = (
    "idx AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in INDEX_COLUMNS.items())
    + ", TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, embedding"
    + " FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))"
)


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk index: one row per document, vectors shared among rows (ties)."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    rows = docs.selectExpr(
        *[f"{e} AS {c}" for c, e in INDEX_COLUMNS.items()],
        "timestampadd(MINUTE, doc_id, TIMESTAMP '2024-01-01 00:00:00') AS created_at",
        f"doc_id % {n_vectors(spark, sf_dir)} AS vec_id")
    return rows.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")


@lru_cache(maxsize=8)
def _postings_path(app_id: str, sf_dir: str) -> str:
    spark = SparkSession.getActiveSession()
    path = shared_dir(spark, "postings")
    write_postings(index_chunks(spark, sf_dir), path)
    return path


def index_postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The postings of the chunk index; written once in a session, as an index keeps them."""
    return read_postings(spark, _postings_path(spark.sparkContext.applicationId, sf_dir))


@lru_cache(maxsize=8)
def _buckets_path(app_id: str, sf_dir: str, to: Projections) -> str:
    spark = SparkSession.getActiveSession()
    path = shared_dir(spark, "buckets")
    write_buckets(index_chunks(spark, sf_dir).select("id", "embedding"), path, to)
    return path


@lru_cache(maxsize=8)
def _projections(app_id: str, dimension: int) -> Projections:
    return fit_hashing(SparkSession.getActiveSession(), dimension)


def index_buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Projections]:
    """The hash buckets of the chunk index and what named them; written once in a session."""
    app = spark.sparkContext.applicationId
    to = _projections(app, table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0])
    return spark.read.parquet(_buckets_path(app, sf_dir, to)), to


QUERY_TEXT = "CASE WHEN item_id % 4 = 0 THEN concat(text, ' doc-', CAST(item_id AS VARCHAR(20))) ELSE text END"
QUERY_CATEGORY = (
    "CASE CAST(item_id % 6 AS INT) WHEN 1 THEN 'compliance' WHEN 3 THEN 'multimedia' ELSE NULL END"
)
QUESTIONS_SQL = (
    f"questions AS (SELECT item_id AS query_id, {QUERY_TEXT} AS query, "
    "CASE WHEN item_id % 2 = 1 THEN list_reverse(embedding) ELSE embedding END AS query_vec, "
    f"CAST(5 + item_id % 6 AS INT) AS top_k, {QUERY_CATEGORY} AS category "
    "FROM benchmark JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings))"
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per benchmark item; reversed vectors make weak matches that the guard tests."""
    items = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id", f"{QUERY_TEXT} AS query", "CAST(5 + item_id % 6 AS INT) AS top_k",
        f"{QUERY_CATEGORY} AS category", "item_id % 2 = 1 AS flip",
        f"item_id % {n_vectors(spark, sf_dir)} AS vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return items.join(vectors, "vec_id").select(
        "query_id", "query", F.when(F.col("flip"), F.reverse("embedding")).otherwise(F.col("embedding")).alias("query_vec"),
        "top_k", "category")


def with_index(body: str) -> str:
    return f"WITH {INDEX_SQL}, {QUESTIONS_SQL} {body}"


# --- answers --------------------------------------------------------------------

ANSWER_TAIL = (
    "CASE CAST((conv_id + turn) % 8 AS INT) "
    "WHEN 0 THEN concat(' [Citation: local://compliance/doc-', CAST(conv_id AS VARCHAR(20)), '.md, Section 1] in 2024.') "
    "WHEN 1 THEN concat(' [Cite: doc-', CAST(conv_id AS VARCHAR(20)), '.md (Section 2)]. About 48% of Dr. Pine Labs. agreed.') "
    "WHEN 2 THEN concat(' It was July 15, 2025 [Citation: doc-', CAST(conv_id AS VARCHAR(20)), '.md | Location: Section 3].') "
    "WHEN 3 THEN concat(' See CVE-2024-', CAST(1000 + conv_id AS VARCHAR(20)), ' and $4.8 M [citation: doc-', "
    "CAST(turn AS VARCHAR(20)), '.md | Section 1]. [Source: x.md, p 1]') "
    "WHEN 4 THEN ' I cannot find this in the indexed documents.' "
    "WHEN 5 THEN concat(' T1059.001 since 2019-05-04 [1].', chr(10), '[1] source: doc-', CAST(conv_id AS VARCHAR(20)), "
    "'.md, location: Section 1') "
    "WHEN 6 THEN concat(chr(10), '[2] source: doc-', CAST(conv_id AS VARCHAR(20)), '.md, location: page 2') "
    "ELSE '' END"
)
ANSWER_HEAD = (
    "CASE CAST(conv_id % 6 AS INT) WHEN 0 THEN 'Based on the context. ' WHEN 1 THEN 'Here is the list of what was asked. ' "
    "WHEN 2 THEN 'The provided context does not contain that. ' WHEN 3 THEN 'The [Job Title] is unknown to the team. ' "
    "ELSE '' END"
)
ANSWER_COLUMNS = {
    "answer_id": "conv_id * 1000 + turn",
    "conv_id": "conv_id",
    "turn": "turn",
    "answer": f"concat({ANSWER_HEAD}, text, {ANSWER_TAIL})",
}
ANSWERS_SQL = (
    "answers AS (SELECT " + ", ".join(f"a.{c}" for c in ANSWER_COLUMNS)
    + ", q.text AS question FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ANSWER_COLUMNS.items())
    + " FROM conversations WHERE role = 'assistant') a"
    " JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1)"
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before them; text gains citations, claims and refusals."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    a = turns.filter("role = 'assistant'").selectExpr(*[f"{e} AS {c}" for c, e in ANSWER_COLUMNS.items()])
    q = turns.selectExpr("conv_id", "turn + 1 AS turn", "text AS question")
    return a.join(q, ["conv_id", "turn"])


# evidence: for every answer the chunks of the file its conversation id names, and
# a chunk that repeats the conversation's own words
EVIDENCE_SQL = (
    "evidence AS (SELECT a.answer_id, CAST(1 + d.doc_id % 3 AS INT) AS rank, "
    "concat('local://compliance/doc-', CAST(a.conv_id AS VARCHAR(20)), '.md') AS source, "
    "concat('Section ', CAST(1 + d.doc_id % 3 AS VARCHAR(20))) AS location, d.text AS content "
    f"FROM answers a JOIN documents d ON CAST(floor(d.doc_id / 3) AS BIGINT) = a.conv_id "
    "UNION ALL SELECT a.answer_id, CAST(4 + c.turn AS INT), concat('notes/turn-', CAST(c.turn AS VARCHAR(20)), '.md'), "
    "'Section 1', c.text FROM answers a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn IN (a.turn, a.turn - 1))"
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks per answer: at most three of a file and two turns."""
    a = answers(spark, sf_dir).select("answer_id", "conv_id", "turn")
    docs = table(spark, sf_dir, "documents").selectExpr(
        f"{FILE_NO} AS conv_id", "CAST(1 + doc_id % 3 AS INT) AS rank",
        "concat('Section ', 1 + doc_id % 3) AS location", "text AS content")
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn AS of_turn", "text AS content")
    files = a.join(docs, "conv_id").selectExpr(
        "answer_id", "rank", "concat('local://compliance/doc-', conv_id, '.md') AS source", "location", "content")
    near = a.withColumn("of_turn", F.explode(F.array("turn", F.col("turn") - 1))).join(turns, ["conv_id", "of_turn"])
    return files.unionByName(near.selectExpr(
        "answer_id", "CAST(4 + of_turn AS INT) AS rank", "concat('notes/turn-', of_turn, '.md') AS source",
        "'Section 1' AS location", "content"))


def with_answers(body: str, evidence_too: bool = False) -> str:
    return f"WITH {ANSWERS_SQL}{', ' + EVIDENCE_SQL if evidence_too else ''} {body}"
