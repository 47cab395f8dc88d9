"""Search: lexical, dense, hybrid, and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.tables import as_pages, table
from . import sql as Q

QUERY, PHRASE, NEAR, LIMIT = "the of was idiot the", "of the", 7, 8


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(table(spark, sf_dir, "documents"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("string").alias("parent_id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == NEAR).select(F.col("embedding").alias("q"))


def _lexical(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return S.bm25(S.admit(pages(spark, sf_dir)), query)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), S.candidates(LIMIT))
    return S.vector_scores(hits, S.admit(pages(spark, sf_dir)))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, QUERY).select("id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(10)


def bm25_phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, PHRASE).select("id", F.round("bm25", 6).alias("bm25"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("t"))
    return docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.corpus_stats(S.admit(pages(spark, sf_dir)), ["the", "of"])
    return rows.select("n", F.round("avgdl", 6).alias("avgdl"), F.get("df", F.lit(0)).alias("df_the"), F.get("df", F.lit(1)).alias("df_of"))


def keyword_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_contributions(S.admit(pages(spark, sf_dir)), QUERY).drop("term_no")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return hits.select("id", "label", F.round("distance", 6).alias("distance"), F.round(1.0 / (1.0 + F.col("distance")), 6).alias("score"))


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 50)
    allowed = S.admit(pages(spark, sf_dir), types=["concept"])
    return S.vector_scores(hits, allowed).select("id", F.round("vector", 6).alias("score"))


def score_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.min_max(_lexical(spark, sf_dir, QUERY), "bm25", "scaled").select("id", F.round("scaled", 6).alias("scaled"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hybrid(pages(spark, sf_dir), vectors(spark, sf_dir), PHRASE, query_vector(spark, sf_dir), LIMIT).drop("tags", "confidence")


def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trace(_lexical(spark, sf_dir, QUERY), _dense(spark, sf_dir), S.admit(pages(spark, sf_dir)), LIMIT)


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir)
    return S.candidate_counts(every, S.admit(every), _lexical(spark, sf_dir, QUERY), _dense(spark, sf_dir), hybrid_search(spark, sf_dir))


def filter_type_tags_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.admit(pages(spark, sf_dir), True, ["entity", "raw"], ["fr", "src3"]).select("id", "path", "type", "is_raw")


def read_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    return rows.select("id", T.read_hint(F.col("path"), F.col("heading"), F.col("start_line"), F.col("end_line")).alias("hint"), T.read_hint(F.col("path"), F.lit(""), F.lit(0), F.col("end_line")).alias("bare"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), ["idiot", "was", "zzz"]).alias("snippet"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_phrase_bonus, doc_freq, corpus_stats, keyword_contributions, knn_topk, knn_postfilter, score_normalize, hybrid_search, search_trace, candidate_counts, filter_type_tags_raw, read_hints, snippets)}

_LEX = f"WITH {Q.PAGES}, {Q.bm25(QUERY, 'NOT is_raw')}"
_PHRASED = f"{Q.PAGES}, {Q.bm25(PHRASE, 'NOT is_raw')}"
_DENSE = f"{Q.knn(NEAR, 80)}, vs AS (SELECT kn.id, 1.0 / (1.0 + greatest(distance, 0)) AS vector FROM kn JOIN pg ON kn.id = pg.id WHERE NOT is_raw)"
_HINT = "path || '#' || heading || ' lines ' || start_line || '-' || end_line"


def _snip(text: str, terms: list[str]) -> str:
    found = ", ".join(f"nullif(strpos(lower({text}), '{t}'), 0)" for t in terms)
    start = f"greatest(coalesce(list_min([{found}]), 1) - 1 - 80, 0)"
    return f"""CASE WHEN {start} > 0 THEN '…' ELSE '' END || trim(replace(substring({text}, ({start} + 1)::BIGINT, 240), chr(10), ' '), ' ')
      || CASE WHEN {start} + 240 < length({text}) THEN '…' ELSE '' END"""


_HYBRID = f"""hy AS (
  SELECT pg.id, path, title, heading, round(0.35::DOUBLE * coalesce(b.scaled, 0) + 0.65::DOUBLE * coalesce(v.scaled, 0)
           + CASE WHEN contains(lower(body), '{PHRASE}') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN is_raw THEN 0 ELSE 0.01::DOUBLE END, 6) AS score,
         type, {_snip('text', PHRASE.split())} AS snippet, round(coalesce(bm25, 0), 6) AS bm25_score, round(coalesce(vector, 0), 6) AS vector_score, start_line, end_line, {_HINT} AS read_hint
  FROM (SELECT * FROM ({Q.min_max('bm', 'bm25')})) b FULL JOIN (SELECT * FROM ({Q.min_max('vs', 'vector')})) v ON b.id = v.id
  JOIN pg ON pg.id = coalesce(b.id, v.id)
  ORDER BY score DESC, path, start_line, pg.id LIMIT {LIMIT}
)"""
_CONTRIB = " UNION ALL ".join(
    f"SELECT '{w}' AS term, id, {Q.BM25_TERM.format(f=f'''len(list_filter(t, lambda x: x = '{w}'))''', df=f'df{i}')} AS c FROM tk, stt" for i, w in enumerate(dict.fromkeys(QUERY.split()))
)

SQL = {
    "bm25_topk": f"{_LEX} SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 6) DESC, id LIMIT 10",
    "bm25_phrase_bonus": f"WITH {_PHRASED} SELECT id, round(bm25, 6) AS bm25 FROM bm",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({Q.tok('text')})) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"WITH {Q.PAGES}, {Q.bm25('the of', 'NOT is_raw')} SELECT n, round(avgdl, 6) AS avgdl, df0 AS df_the, df1 AS df_of FROM stt",
    "keyword_contributions": f"""{_LEX}, co AS (SELECT term, id, round(c, 6) AS c FROM ({_CONTRIB}) WHERE c > 0
), rk AS (
  SELECT term, count(*) OVER (PARTITION BY term) AS matching_chunks, row_number() OVER (PARTITION BY term ORDER BY c DESC, path, start_line, id) AS rank,
         path, heading, c AS bm25_contribution, {_HINT} AS read_hint
  FROM co JOIN pg USING (id)
) SELECT * FROM rk WHERE rank <= 5""",
    "knn_topk": f"WITH {Q.knn(NEAR, 10)} SELECT id, label, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM kn JOIN embeddings ON id = vec_id::VARCHAR",
    "knn_postfilter": f"WITH {Q.PAGES}, {Q.knn(NEAR, 50)} SELECT kn.id, round(1 / (1 + greatest(distance, 0)), 6) AS score FROM kn JOIN pg ON kn.id = pg.id WHERE type = 'concept' AND NOT is_raw",
    "score_normalize": f"{_LEX} SELECT id, round(scaled, 6) AS scaled FROM ({Q.min_max('bm', 'bm25')})",
    "hybrid_search": f"WITH {_PHRASED}, {_DENSE}, {_HYBRID} SELECT * FROM hy",
    "search_trace": f"""{_LEX}, {_DENSE}, tr AS (
  SELECT 'bm25' AS stage, * FROM (SELECT id, round(bm25, 6) AS score FROM bm ORDER BY bm25 DESC, id LIMIT {LIMIT})
  UNION ALL SELECT 'vector', * FROM (SELECT id, round(vector, 6) FROM vs ORDER BY vector DESC, id LIMIT {LIMIT})
) SELECT stage, id, path, heading, score, {_HINT} AS read_hint FROM tr JOIN pg USING (id)""",
    "candidate_counts": f"""{_LEX}, {_DENSE} SELECT (SELECT count(*) FROM pg) AS chunks_total, (SELECT count(*) FROM tk) AS chunks_after_filters,
  (SELECT count(*) FROM bm) AS bm25_nonzero, (SELECT count(*) FROM vs) AS vector_hits, {LIMIT} AS returned""",
    "filter_type_tags_raw": f"WITH {Q.PAGES} SELECT id, path, type, is_raw FROM pg WHERE type IN ('entity', 'raw') AND list_has_any(tags, ['fr', 'src3'])",
    "read_hints": f"WITH {Q.PAGES} SELECT id, {_HINT} AS hint, path AS bare FROM pg",
    "snippets": f"SELECT doc_id, {_snip('text', ['idiot', 'was', 'zzz'])} AS snippet FROM documents",
}
