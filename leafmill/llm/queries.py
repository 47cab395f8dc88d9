"""One thin query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, lm_scoring, minhash, mixing, packing, quality_classifier, quality_rules, toxicity, warc
from .common import input_table, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(input_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


#: The mix takes the first words of each source's repeated stream, as many as its slots hold.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, (place - 1) % 3 + 1 AS w, sum(source_size) OVER ()::BIGINT AS total FROM s
), f AS (
  SELECT *, 3 * source_size / w AS r,
         (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(w) OVER (ORDER BY 3 * source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, place, source_size, total,
         least((3 * source_size)::DOUBLE, w * (SELECT level FROM f WHERE level <= r ORDER BY r, place LIMIT 1)) AS target
  FROM f
), c AS (
  SELECT *, sum(target) OVER (ORDER BY place) AS upto, sum(target) OVER () AS whole FROM t
), b AS (
  SELECT max(greatest(1, total // 262144)) AS step, max(total) AS total FROM t
), p AS (
  SELECT i::DOUBLE * 0.6180339887498949::DOUBLE - floor(i::DOUBLE * 0.6180339887498949::DOUBLE) AS u
  FROM (SELECT unnest(range((SELECT (total + step - 1) // step FROM b))) AS i)
), n AS (
  SELECT place, count(u) * any_value(step) AS words
  FROM (SELECT place, coalesce(lag(upto) OVER (ORDER BY place), 0) / whole AS lo,
               CASE WHEN upto >= whole * (1 - 1e-12) THEN 2.0::DOUBLE ELSE upto / whole END AS hi, target FROM c) x
  LEFT JOIN p ON u >= lo AND u < hi AND target > 0, b
  GROUP BY place
), o AS (
  SELECT d.*, t.place, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY t.place ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (SELECT sum(greatest(0, least(size, words - begins - e * source_size))) FROM (SELECT unnest([0, 1, 2]) AS e))::BIGINT AS taken
FROM o JOIN n USING (place)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(input_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(input_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.digests(warc.captures(spark, path))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS stored FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to
FROM m
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good; the background is all documents."""
    return lm_scoring.score(lm_scoring.with_target(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.annotate(input_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(input_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "participant", "piece", "start", "n_turns", "text", F.size("spans").cast("long").alias("n_spans"), "masked_chars")


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start\|>|im_end\|>)', '< |\1', 'g') AS text
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'
), r AS (
  SELECT t.*, participant, CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(role, '[^\p{L}\p{N}_-]', '_', 'g') END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
)
SELECT conv_id, participant, 0::BIGINT AS piece, 0::BIGINT AS start, count(*) AS n_turns,
       string_agg('<|im_start|>' || head || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text,
       count_if(role = participant)::BIGINT AS n_spans,
       coalesce(sum(length(text) + 10) FILTER (WHERE role = participant), 0)::BIGINT AS masked_chars
FROM r GROUP BY conv_id, participant
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_classifier.score(docs, input_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, input_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(input_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM d
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
  FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY rid
), m AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base,
         10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > n_words AS dup_lines,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length
  FROM m
), h AS (
  SELECT host, count(*) AS n, count_if(base) AS k1, count_if(symbols) AS k2,
         count_if(dup_lines) AS k3, count_if(word_length) AS k4
  FROM f GROUP BY host
), p AS (
  SELECT sum(k1) / sum(n) AS m1, var_pop(k1 / n) AS v1, sum(k2) / sum(n) AS m2, var_pop(k2 / n) AS v2,
         sum(k3) / sum(n) AS m3, var_pop(k3 / n) AS v3, sum(k4) / sum(n) AS m4, var_pop(k4 / n) AS v4
  FROM h
), s AS (
  SELECT h.*, p.*,
         CASE WHEN v1 > 0 THEN greatest(m1 * (1 - m1) / v1 - 1, 0) END AS s1,
         CASE WHEN v2 > 0 THEN greatest(m2 * (1 - m2) / v2 - 1, 0) END AS s2,
         CASE WHEN v3 > 0 THEN greatest(m3 * (1 - m3) / v3 - 1, 0) END AS s3,
         CASE WHEN v4 > 0 THEN greatest(m4 * (1 - m4) / v4 - 1, 0) END AS s4
  FROM h, p
), v AS (
  SELECT host, coalesce((k1 + m1 * s1) / (n + s1), m1) > 0.5 OR coalesce((k2 + m2 * s2) / (n + s2), m2) > 0.5
      OR coalesce((k3 + m3 * s3) / (n + s3), m3) > 0.5 OR coalesce((k4 + m4 * s4) / (n + s4), m4) > 0.5 AS bad
  FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base AS base_failed, NOT base AND NOT bad AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
}
SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_warc": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_quality_rules": OP10_SQL}
