"""Verbosity, repetition, rewrites, semantic structure, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import embed as E
from ..operators import semantic as M
from ..operators import verbosity as V
from ..sources.tables import as_markdown, page_path, table
from . import sql as Q


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(page_path().alias("path"), "text", F.col("text").alias("body"), F.lit(0).alias("frontmatter_lines"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_markdown(table(spark, sf_dir, "conversations"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judge(V.metrics(documents(spark, sf_dir), with_gzip=False))


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the index is a sum of three terms and can fall on a tie of the third place: it is compared in full
    rows = V.metrics(documents(spark, sf_dir), with_gzip=False)
    return V.rounded(rows.withColumn("ari_exact", F.col("ari_score")), "ari_exact").drop("gzip_ratio", "ari_score")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    return _tokens(spark, sf_dir).select("doc_id", *[F.round(T.repeated_ratio(T.ngram_hashes(T.hashes(t), n)), 6).alias(f"repeated_{n}") for n in (5, 8)])


def top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_phrases(_tokens(spark, sf_dir), "doc_id")


def near_dup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", V.content_sets(T.sentences(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.round(V.near_duplicate_ratio(F.col("s")), 6).alias("near_dup"))


def heading_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown(spark, sf_dir).select("path", V.sections(F.col("body"), F.lit(0)).alias("s"))
    return rows.select("path", F.round(V.heading_repetition(F.col("s")), 6).alias("heading_repetition"))


def verbosity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_join(F.array_sort(F.transform("reasons", lambda r: r["code"])), ",")
    return _judged(spark, sf_dir).select("path", codes.alias("codes"), "score", "severity", "is_verbose", F.array_join("suggestions", ",").alias("suggestions"))


def section_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.section_results(V.metrics(markdown(spark, sf_dir), with_gzip=False))
    return rows.select("path", "rank", "heading", "start_line", "end_line", "line_count", "score", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"))


def verbosity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.audit(_judged(spark, sf_dir).select("path", "severity", "score", *V.PERCENTILES), 20, "warning")
    return rows.select("path", "score", "line_count", *[f"{m}_percentile" for m in V.PERCENTILES])


def verbosity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.judge(V.metrics(documents(spark, sf_dir)))
    return rows.select("path", "score", "severity", F.round("gzip_ratio", 6).alias("gzip_ratio"), "reasons", "suggestions")


def rewrite_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("rewrite"))
    pairs = table(spark, sf_dir, "documents").join(bench, "doc_id").select(page_path().alias("path"), F.col("text").alias("source"), "rewrite")
    return V.compare(pairs).withColumn("codes", F.array_join(F.transform("compare_reasons", lambda r: r["code"]), ",")).drop("compare_reasons")


def semantic_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("page"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return M.structure(rows, "page").select("page", "section_count", "adjacent_pairs", "pairwise_pairs", "semantic_structure_score", "coherence_score", "semantic_redundancy_score")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.embed(E.create(), F.col("text")).alias("vector"))


def pack_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.locators(C.chunk(markdown(spark, sf_dir)), 48).select("id", "parent_id", "vector_ordinal", "start_line", "end_line", F.size(T.tokens(F.col("text"))).alias("tokens"))


def gzip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(V.gzip_ratio("text"), 6).alias("gzip_ratio"))


QUERIES = {
    f.__name__: f
    for f in (page_metrics, repeated_ngrams, top_phrases, near_dup_sentences, heading_repetition, verbosity_rules, section_rules, verbosity_audit, verbosity_full, rewrite_compare, semantic_structure, hash_embed, pack_locators, gzip_ratio)
}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _noise(x: str) -> str:
    for pattern, by in ((r"`([^`\n]+)`", " "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", r"\1"), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*(?:[-*+] |\d+[.)] )", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _sentences(x: str) -> str:
    trim = r"'^\s+|\s+$', '', 'g'"
    compact = rf"regexp_replace(regexp_replace({x}, {trim}), '\s+', ' ', 'g')"
    parts = rf"string_split(regexp_replace({compact}, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))"
    chosen = rf"CASE WHEN {compact} = '' THEN [] WHEN len({parts}) = 1 THEN regexp_split_to_array({x}, '\n+|;\s+') ELSE {parts} END"
    return f"list_filter(list_transform({chosen}, lambda z: regexp_replace(z, {trim})), lambda z: z <> '')"


def _repeat(t: str, n: int) -> str:
    grams = f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"
    return f"CASE WHEN len({t}) < {n} THEN 0 ELSE (len({t}) - {n - 1} - len(list_distinct({grams}))) / (len({t}) - {n - 1}) END"


def _near(source: str) -> str:
    """CTE nd (k, near_dup) from (k, s: sentences)."""
    return f"""n1 AS (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM {source}
), n2 AS (SELECT k, i, list_distinct(list_filter({Q.tok('s[i]')}, lambda z: NOT list_contains({_STOP}, z))) AS t FROM n1
), n3 AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM n2 WHERE len(t) >= 4
), n4 AS (SELECT a.k, len(list_intersect(a.t, b.t)) AS x, len(a.t) + len(b.t) AS y FROM n3 a JOIN n3 b ON a.k = b.k AND b.r > a.r AND b.r <= a.r + 40
), nd AS (SELECT k, count_if(x / (y - x) >= 0.82) / count(*) AS near_dup FROM n4 GROUP BY k)"""


_METRICS = rf"""v1 AS (
  SELECT {Q.PATH} AS path, text, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents
), v2 AS (
  SELECT *, {_noise("array_to_string(list_filter(ls, lambda z: z NOT LIKE '    %' AND z NOT LIKE chr(9) || '%'), chr(10))")} AS prose, regexp_replace(text, '^\s+|\s+$', '', 'g') AS st FROM v1
), v3 AS (
  SELECT *, {Q.tok('prose')} AS t, {_sentences('prose')} AS s FROM v2
), v4 AS (
  SELECT *, list_filter(list_transform(s, lambda z: len(regexp_extract_all(z, '{Q.TOKEN}'))), lambda z: z > 0) AS sl, path AS k,
         list_filter(t, lambda z: NOT list_contains({_STOP}, z)) AS ns, list_filter(t, lambda z: NOT list_contains({_STOP}, z) AND NOT regexp_full_match(z, '\d+')) AS ct,
         CASE WHEN st = '' THEN 0 ELSE length(st) - length(replace(st, chr(10), '')) + 1 END AS sec FROM v3
), {_near('v4')}, vm AS (
  SELECT path, s, len(ls) AS line_count, len(ls) AS body_line_count, len(t) AS word_count, length(text) AS char_count, (st <> '')::INT AS heading_count,
         CASE WHEN st = '' THEN len(ls) ELSE sec END AS max_section_lines, sec::DOUBLE AS avg_section_lines, len(ls)::DOUBLE AS lines_per_heading,
         len(list_filter(ls, lambda z: regexp_matches(z, '^\s*(?:[-*+] |\d+[.)] )'))) / greatest(len(ls), 1) AS bullet_line_ratio,
         len(list_filter(ls, lambda z: contains(z, '|') OR regexp_matches(z, '^\s*\|?\s*:?-{{3,}}:?'))) / greatest(len(ls), 1) AS table_line_ratio,
         len(list_filter(ls, lambda z: z LIKE '    %' OR z LIKE chr(9) || '%')) / greatest(len(ls), 1) AS code_line_ratio,
         len(regexp_extract_all(text, '\[\[[^\]]+\]\]')) AS wikilink_count, len(regexp_extract_all(text, '\[[^\]]+\]\([^\)]+\)')) AS markdown_link_count,
         len(sl) AS sentence_count, coalesce(list_sum(sl), 0) / greatest(len(sl), 1) AS avg_sentence_words, coalesce(list_max(sl), 0) AS max_sentence_words,
         len(list_filter(sl, lambda z: z >= 30)) AS long_sentence_count, len(list_filter(sl, lambda z: z >= 30)) / greatest(len(sl), 1) AS long_sentence_ratio,
         length(array_to_string(t, '')) / greatest(len(t), 1) AS avg_word_chars,
         4.71::DOUBLE * (length(array_to_string(t, '')) / greatest(len(t), 1)) + 0.5::DOUBLE * (len(t) / greatest(len(sl), 1)) - 21.43::DOUBLE AS ari_score,
         {_repeat('t', 5)} AS repeated_5gram_ratio, {_repeat('t', 8)} AS repeated_8gram_ratio, coalesce(near_dup, 0) AS near_duplicate_sentence_ratio,
         CASE WHEN st <> '' AND len(list_filter({Q.tok('st')}, lambda z: z = 'document')) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS heading_repetition_ratio,
         len(list_distinct(t)) / greatest(len(t), 1) AS unique_token_ratio, len(list_distinct(ct)) / greatest(len(ct), 1) AS unique_content_word_ratio,
         len(ct) / greatest(len(t), 1) AS lexical_density, (len(t) - len(ns)) / greatest(len(t), 1) AS stopword_ratio
  FROM v4 LEFT JOIN nd USING (k)
)"""
_RULES = (
    ("line_count_high", "line_count >= 300", 0.22), ("line_count_warning", "line_count >= 200 AND line_count < 300", 0.10), ("word_count_high", "word_count >= 3000", 0.10),
    ("section_too_long", "max_section_lines >= 120", 0.20), ("section_warning", "max_section_lines >= 80 AND max_section_lines < 120", 0.08),
    ("understructured_long_page", "line_count >= 200 AND heading_count < line_count / 80", 0.14), ("long_page_low_links", "line_count >= 200 AND wikilink_count + markdown_link_count < 2", 0.08),
    ("wall_of_text", "line_count >= 120 AND bullet_line_ratio + table_line_ratio < 0.08 AND heading_count <= 2", 0.14), ("avg_sentence_too_long", "avg_sentence_words >= 28", 0.08),
    ("long_sentence_ratio_high", "long_sentence_ratio >= 0.25", 0.08), ("sentence_extreme", "max_sentence_words >= 80", 0.08), ("repeated_5grams", "repeated_5gram_ratio >= 0.08", 0.12),
    ("near_duplicate_sentences", "near_duplicate_sentence_ratio >= 0.10", 0.12), ("low_unique_content_ratio", "word_count >= 500 AND unique_content_word_ratio < 0.36", 0.08),
    ("low_lexical_density", "word_count >= 500 AND lexical_density < 0.42", 0.06),
)
_HAS = {c: f"({cond})" for c, cond, _ in _RULES}
_JUDGED = f"""{_METRICS}, j1 AS (
  SELECT *, {' + '.join(f"CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0 END" for _, cond, w in _RULES)} AS w,
         list_sort(list_filter([{', '.join(f"CASE WHEN {cond} THEN '{c}' END" for c, cond, _ in _RULES)}], lambda z: z IS NOT NULL)) AS codes FROM vm
), j2 AS (
  SELECT *, CASE WHEN line_count >= 200 AND heading_count >= line_count / 60 AND max_section_lines < 80 THEN greatest(0, least(1, w) - 0.08) ELSE least(1, w) END AS w2 FROM j1
), j3 AS (
  SELECT *, CASE WHEN bullet_line_ratio + table_line_ratio >= 0.25 AND repeated_5gram_ratio < 0.08 THEN greatest(0, w2 - 0.05) ELSE w2 END AS w3 FROM j2
), j4 AS (
  SELECT *, round(least(1, CASE WHEN line_count >= 300 OR max_section_lines >= 120 THEN greatest(w3, 0.65) ELSE w3 END)::DOUBLE, 6) AS score FROM j3
), jd AS (
  SELECT *, CASE WHEN score >= 0.65 OR {_HAS['line_count_high']} OR {_HAS['section_too_long']} THEN 'high' WHEN score >= 0.35 OR len(codes) > 0 THEN 'warning' ELSE 'ok' END AS severity FROM j4
)"""
_SUGGEST = "array_to_string(list_filter([{}], lambda z: z IS NOT NULL), ',')".format(", ".join(
    f"CASE WHEN {cond} THEN '{name}' END" for name, cond in (
        ("split_by_heading", f"{_HAS['line_count_high']} AND heading_count >= 4"), ("add_headings", f"{_HAS['understructured_long_page']} OR {_HAS['wall_of_text']}"), ("add_wikilinks", _HAS["long_page_low_links"]),
        ("extract_deep_dive_page", _HAS["section_too_long"]), ("deduplicate_repeated_claims", f"{_HAS['repeated_5grams']} OR {_HAS['near_duplicate_sentences']}"),
        ("shorten_sentences", f"{_HAS['avg_sentence_too_long']} OR {_HAS['long_sentence_ratio_high']} OR {_HAS['sentence_extreme']}"), ("replace_prose_with_table_or_bullets", f"{_HAS['low_unique_content_ratio']} OR {_HAS['low_lexical_density']}"),
    )
))
_VEC = "(SELECT vec_id % 50 AS page, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS r FROM embeddings)"
_WORDS = "regexp_extract_all({}, '\\[\\[[^\\]]+\\]\\]')"

SQL = {
    "page_metrics": f"WITH {_METRICS} SELECT path, {', '.join(V.COUNTS)}, ari_score AS ari_exact, {', '.join(f'round({c}, 3) AS {c}' for c in V.THREE_PLACES if c != 'ari_score')}, {', '.join(f'round({c}, 6) AS {c}' for c in V.SIX_PLACES if c != 'gzip_ratio')} FROM vm",
    "repeated_ngrams": f"WITH d AS (SELECT doc_id, {Q.tok('text')} AS t FROM documents) SELECT doc_id, round({_repeat('t', 5)}, 6) AS repeated_5, round({_repeat('t', 8)}, 6) AS repeated_8 FROM d",
    "top_phrases": f"""WITH d AS (SELECT doc_id, {Q.tok('text')} AS t FROM documents
), g AS (SELECT doc_id, i, array_to_string(t[i:i + 4], ' ') AS phrase FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM d WHERE len(t) >= 5)
), c AS (SELECT doc_id, phrase, count(*) AS count, min(i) AS f FROM g GROUP BY doc_id, phrase
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, f) AS rank FROM c
) SELECT doc_id, rank, phrase, count FROM r WHERE rank <= 5 AND count > 1 AND len(list_filter(string_split(phrase, ' '), lambda z: NOT list_contains({_STOP}, z))) > 0""",
    "near_dup_sentences": f"WITH d AS (SELECT doc_id AS k, {_sentences('text')} AS s FROM documents), {_near('d')} SELECT k AS doc_id, round(coalesce(near_dup, 0), 6) AS near_dup FROM d LEFT JOIN nd USING (k)",
    "heading_repetition": f"""WITH {Q.SECTIONS}, h AS (
  SELECT path, unnest(list_filter({Q.tok('heading')}, lambda z: NOT list_contains({_STOP}, z))) AS w, text FROM sx
) SELECT path, round(count_if(len(list_filter({Q.tok('text')}, lambda z: z = w)) >= 6) / count(*), 6) AS heading_repetition FROM h GROUP BY path""",
    "verbosity_rules": f"WITH {_JUDGED} SELECT path, array_to_string(codes, ',') AS codes, score, severity, severity <> 'ok' AS is_verbose, {_SUGGEST} AS suggestions FROM jd",
    "section_rules": f"""WITH {Q.SECTIONS}, a AS (
  SELECT *, {Q.tok(_noise('text'))} AS t, list_filter(list_transform({_sentences('text')}, lambda z: len(regexp_extract_all(z, '{Q.TOKEN}'))), lambda z: z > 0) AS sl, end_line - start_line + 1 AS n FROM sx
), b AS (
  SELECT *, list_filter(t, lambda z: NOT list_contains({_STOP}, z) AND NOT regexp_full_match(z, '\\d+')) AS ct, {_repeat('t', 5)} AS rep FROM a
), c AS (
  SELECT path, heading, start_line, end_line, n, n >= 120 AS r1, n >= 80 AND n < 120 AS r2, len(sl) > 0 AND list_sum(sl) / len(sl) >= 28 AS r3, rep >= 0.08 AS r4,
         len(t) >= 150 AND len(list_distinct(ct)) / greatest(len(ct), 1) < 0.36 AS r5, n >= 80 AND NOT regexp_matches(text, '\\[\\[[^\\]]+\\]\\]|\\[[^\\]]+\\]\\([^\\)]+\\)') AS r6 FROM b
), d AS (
  SELECT *, round(r1::INT * 0.2::DOUBLE + r2::INT * 0.08::DOUBLE + coalesce(r3, false)::INT * 0.08::DOUBLE + r4::INT * 0.12::DOUBLE + r5::INT * 0.08::DOUBLE + r6::INT * 0.08::DOUBLE, 6) AS score,
         list_filter([CASE WHEN r1 THEN 'section_too_long' END, CASE WHEN r2 THEN 'section_warning' END, CASE WHEN r3 THEN 'avg_sentence_too_long' END, CASE WHEN r4 THEN 'repeated_5grams' END,
                      CASE WHEN r5 THEN 'low_unique_content_ratio' END, CASE WHEN r6 THEN 'long_page_low_links' END], lambda z: z IS NOT NULL) AS codes FROM c
) SELECT path, (row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line) - 1)::INT AS rank, heading, start_line, end_line, n AS line_count, score, array_to_string(codes, ',') AS codes FROM d WHERE len(codes) > 0""",
    "verbosity_audit": f"""WITH {_JUDGED} SELECT path, score, line_count, round(cume_dist() OVER (ORDER BY line_count), 6) AS line_count_percentile,
       round(cume_dist() OVER (ORDER BY max_section_lines), 6) AS max_section_lines_percentile, round(cume_dist() OVER (ORDER BY word_count), 6) AS word_count_percentile
  FROM jd WHERE severity = 'warning' ORDER BY score DESC, line_count DESC, path LIMIT 20""",
    "rewrite_compare": f"""WITH p AS (
  SELECT {Q.PATH.replace('doc_id', 'd.doc_id')} AS path, {Q.tok(_noise('d.text'))} AS s, {Q.tok(_noise('b.text'))} AS r, list_distinct(regexp_extract_all(d.text, '\\[\\[[^\\]]+\\]\\]')) AS sl,
         list_distinct(regexp_extract_all(b.text, '\\[\\[[^\\]]+\\]\\]')) AS rl FROM documents d JOIN benchmark b ON d.doc_id = b.item_id
), q AS (SELECT *, list_distinct(s) AS sd, list_distinct(r) AS rd, len(r) / greatest(len(s), 1) AS ratio, CASE WHEN len(sl) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(sl, rl)) / len(sl) END AS links FROM p
) SELECT path, len(s) AS source_word_count, len(r) AS rewrite_word_count, round(ratio, 6) AS compression_ratio, round(len(list_intersect(sd, rd)) / greatest(len(sd), 1), 6) AS kept_unigrams_ratio,
         round((len(sd) - len(list_intersect(sd, rd))) / greatest(len(sd), 1), 6) AS deleted_unigrams_ratio, round((len(rd) - len(list_intersect(sd, rd))) / greatest(len(rd), 1), 6) AS added_unigrams_ratio,
         0.0::DOUBLE AS heading_preservation_ratio, round(links, 6) AS wikilink_preservation_ratio, CASE WHEN ratio > 0.75 THEN 'rewrite_not_compact,' ELSE '' END || 'rewrite_too_destructive' AS codes FROM q""",
    "semantic_structure": f"""WITH v AS {_VEC}, c AS (
  SELECT a.page, b.r - a.r AS gap, greatest(0, least(1, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))
           / (sqrt(list_sum(list_transform(a.v, lambda z: z * z))) * sqrt(list_sum(list_transform(b.v, lambda z: z * z)))))) AS x FROM v a JOIN v b ON a.page = b.page AND a.r < b.r
), m AS (SELECT page, avg(x) FILTER (WHERE gap = 1) AS coherence, max(x) AS redundancy, count(*) AS pairs, count(*) FILTER (WHERE gap = 1) AS near FROM c GROUP BY page
), n AS (SELECT page, count(*) AS section_count FROM v GROUP BY page)
SELECT page, section_count::INT AS section_count, coalesce(near, 0)::INT AS adjacent_pairs, coalesce(pairs, 0)::INT AS pairwise_pairs,
       round(greatest(0, least(1, 0.55::DOUBLE * coalesce(1 - coherence, 0) + 0.45::DOUBLE * coalesce(redundancy, 0))), 6) AS semantic_structure_score, round(coherence, 6) AS coherence_score, round(redundancy, 6) AS semantic_redundancy_score
FROM n LEFT JOIN m USING (page)""",
}
