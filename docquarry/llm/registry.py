"""Queries of the training-data operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.bpe import decode, encode
from docquarry.llm.chat import format_chat, loss_texts, read_chat
from docquarry.llm import licences
from docquarry.llm.filteraudit import filter_audit
from docquarry.llm.lm import score_texts
from docquarry.llm.neardup import near_duplicates
from docquarry.llm.packing import pack
from docquarry.llm.prefixtrie import conversation_trie
from docquarry.llm.rules import quality
from docquarry.llm.substring import dedup_substrings
from docquarry.llm.toxicity import score, train
from docquarry.llm.urlmodel import Rule, judge_urls
from docquarry.llm.vafile import exact_top_k


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, keep_text=False)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 20) AS t(j) WHERE n > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN), ranks)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(folds: int):
    """Rows whose crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(5))
    done = score(docs, train(docs, labels))
    return done.select("doc_id", held_out(5).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_sentences"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary("word_bpe_49k.json"), length=2048, end_id=1, with_ids=False)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), licences.known_digests(spark))
    return done.select("doc_id", F.array_join("text_licenses", ",").alias("text_licenses"), F.array_join("line_licenses", ",").alias("line_licenses"), "n_lines")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sql = f"regexp_replace(translate(chr(10) || {text}, '{upper}', '{upper.lower()}'), {_quoted(licences.COPYRIGHT_LINE)}, chr(10), 'g')"
    for old, new in licences.SPELLINGS:
        sql = f"replace({sql}, {_quoted(old)}, {_quoted(new)})"
    sql = f"regexp_replace({sql}, {_quoted(licences.MARKS)}, ' ', 'g')"
    return f"list_filter(list_transform(string_split({sql}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


_KNOWN = ", ".join([f"({_quoted(n)}, 'text', {_quoted(t)})" for n, t in licences.TEXTS.items()]
                   + [f"({_quoted(n)}, 'line', {_quoted(t)})" for n, lines in licences.NOTICES.items() for t in lines])
OP5_SQL = f"""
WITH k AS (SELECT DISTINCT license, kind, array_to_string({_canonical_sql("t")}, ' ') AS body FROM (VALUES {_KNOWN}) AS v(license, kind, t)),
d AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
u AS (SELECT doc_id, 'text' AS kind, array_to_string(lines, ' ') AS body FROM d UNION ALL SELECT doc_id, 'line', unnest(lines) FROM d),
m AS (SELECT u.doc_id, u.kind, k.license FROM u LEFT JOIN k ON u.kind = k.kind AND sha256(u.body) = sha256(k.body))
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (kind = 'text'), '') AS text_licenses,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (kind = 'line'), '') AS line_licenses, count(license) FILTER (kind = 'line') AS n_lines
FROM m GROUP BY doc_id
"""


CONTROL = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    done = format_chat(turns.unionByName(extra))
    read = done.withColumn("turns", read_chat(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '[', '&lsqb;'), '<', '&lt;'))
      + CASE WHEN role = before THEN 3
        ELSE 2 + length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '[', '&lsqb;'), '<', '&lt;'), ']', '&rsqb;'), '+', '&plus;')) END AS chars
      FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out(10))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


OP9_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, c.c FROM c JOIN e ON c.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10, scale=1024)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""



URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return done.select("page_id", "host", "path", "rule", "verdict", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie(turns, head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6, base=lambda c: c - c % 100, most=5)


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, x: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT) % 6 AS h
      FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT h.c, h.base, h.h, count(t.c) AS k FROM h LEFT JOIN t ON t.c = h.base AND t.i <= h.h GROUP BY ALL),
r AS (SELECT k.c, t.i AS pos, role, text FROM k JOIN t ON t.c = k.base AND t.i <= k.h
      UNION ALL SELECT k.c, k.k + t.i - k.h, role, text FROM k JOIN t ON t.c = k.c AND t.i > k.h),
p AS (SELECT c, pos, length(text) AS chars, to_json(list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY pos))::VARCHAR AS key FROM r
      UNION ALL SELECT c, 0, 0, '' FROM k),
q AS (SELECT p.*, coalesce(lag(key) OVER (PARTITION BY c ORDER BY pos), NULL) AS up, pos = max(pos) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT key, pos AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY key, pos),
m AS (SELECT n.*, x.conv_id AS parent_conv_id, (SELECT count(*) FROM n y WHERE y.up = n.key) AS n_children FROM n LEFT JOIN n x ON x.key = n.up),
s AS (SELECT q.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens
      FROM m JOIN q ON q.c = m.conv_id AND q.pos <= m.depth GROUP BY q.key)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s ON m.key = s.key
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 10 * length(t.t),
        regexp_matches(t.t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
        EXISTS (FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic
      FROM t JOIN m ON t.t = m.t),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS filter, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before,
        ascii(filter_order[step]) - 64 AS i FROM o, range(1, 6) AS r(step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic,
        list_sum(list_transform(fails, lambda x: x::INT)) AS k FROM f GROUP BY part, fails),
p AS (SELECT part, filter_order, step::INT AS step, filter, n, good, toxic, k, fails[i] AS fails,
        step > 1 AND len(list_filter(before, lambda b: b > 0 AND fails[b])) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM p GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_licence_scan": op5_licence_scan,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op5_licence_scan": OP5_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
