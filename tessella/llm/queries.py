"""One query for each operator, over whole tables with production parameters, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, mixing, packing, quality, repair, simhash, tokencount, urls
from .common import table, tokenizer_path

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    turn = lambda role: F.struct(F.lit(role).alias("role"), said.alias("content"))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(turn("user"), turn("assistant")).alias("messages"))
    return chat.digests(chat.read_back(chat.formatted(rows.unionByName(chat.canonical_turns(one)))))


OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM chats
"""


#: The rules (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP4 = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS r FROM pages),
a AS (SELECT page_id, r, strpos(url, '://') > 0 AS has, substr(url, strpos(url, '://') + 3) AS rest FROM u),
b AS (SELECT page_id, r, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM a),
c AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, h || p) AS k
  FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (r)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.judged(quality.ledger(table(spark, sf_dir, "documents"), "doc_id"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, row_number() OVER () AS r FROM w),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, n_words - 1)) AS i FROM m)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
a AS (SELECT m.*, coalesce(n.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN n USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM a
"""


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.folder(spark)
    repair.write(table(spark, sf_dir, "documents"), path, BYTES)
    return repair.read(spark, path)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_chat, op4_urls, op5_quality, op6_neighbours, op7_language, op8_token_counts, op9_repair, op10_simhash)}
ORACLE: dict[str, str] = {"op3_chat": OP3, "op4_urls": OP4, "op5_quality": OP5}
