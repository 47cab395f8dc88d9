"""Lexical, dense and hybrid search over chunk rows, and its explanation.

A chunk row has at least: id, path, title, heading, type, tags, confidence, text, is_raw,
start_line, end_line. A query's chunks are tokenised once, and what it needs of them is
written: lengths, counts of its terms, the phrase. Statistics are one row and ride along as a
broadcast, so that a chunk is scored where it is read, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..functions.kernels import count_terms
from ..sources.store import cut

BM25_WEIGHT, VECTOR_WEIGHT = 0.35, 0.65
K1, B = 1.5, 0.75
PHRASE_BONUS, PAGE_BONUS, PHRASE_SCORE = 0.05, 0.01, 1.0


def admit(chunks: DataFrame, include_raw: bool = False, types: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Rows that a search may return."""
    if not include_raw:
        chunks = chunks.where(~F.coalesce(F.col("is_raw"), F.lit(False)))
    if types:
        chunks = chunks.where(F.col("type").isin(types))
    if tags:
        chunks = chunks.where(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags])))
    return chunks


def _counted(chunks: DataFrame, terms: list[str], query: str) -> DataFrame:
    """id with its length in tokens, how often it has each term, and whether it has the phrase."""
    body = T.searchable(F.col("title"), F.col("heading"), F.col("tags"), F.col("text"))
    rows = chunks.select("id", body.alias("__body")).select("id", "__body", F.contains(F.lower("__body"), F.lit(query.lower())).alias("phrase"))
    return count_terms(rows, "__body", terms)


def corpus_stats(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n, avgdl and df, the number of chunks with each term."""
    return _stats(_counted(chunks, terms, ""), terms)


def _stats(counted: DataFrame, terms: list[str]) -> DataFrame:
    df = F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))])
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), df.alias("df"))


def _term_score(i: int) -> Column:
    f, df = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
    idf = F.log(1.0 + (F.col("n") - df + 0.5) / (df + 0.5))
    longness = F.greatest(F.col("dl"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-9))
    return F.when(f > 0, idf * (f * (K1 + 1.0) / (f + K1 * (1.0 - B + B * longness)))).otherwise(F.lit(0.0))


def _with_stats(chunks: DataFrame, terms: list[str], query: str) -> DataFrame:
    # written, as a score needs the statistics first, and callers read scores more than once
    counted = cut(_counted(chunks, terms, query), "counted")
    return counted.crossJoin(F.broadcast(_stats(counted, terms)))  # one row


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """(id, bm25) of the chunks that score above 0. A term that the query repeats counts as often;
    the whole query as a phrase adds 1."""
    terms = T.py_tokens(query)
    unique = list(dict.fromkeys(terms))
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("bm25")).limit(0)
    score = F.when(F.col("phrase"), F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    for t in terms:
        score = _term_score(unique.index(t)) + score
    return _with_stats(chunks, unique, query).select("id", score.alias("bm25")).where("bm25 > 0")


def term_contributions(chunks: DataFrame, query: str) -> DataFrame:
    """(term_no, term, id, contribution) of each query term in each chunk that has it."""
    terms = list(dict.fromkeys(T.py_tokens(query)))
    parts = F.array(*[F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("term"), _term_score(i).alias("contribution")) for i, t in enumerate(terms)])
    rows = _with_stats(chunks, terms, query).select("id", F.explode(parts).alias("p"))
    return rows.select("p.term_no", "p.term", "id", "p.contribution").where("contribution > 0")


def knn(vectors: DataFrame, query: DataFrame | list[float], k: int, distance: str = "squared_l2") -> DataFrame:
    """The k nearest rows (all columns and ``distance``), exact. query: a literal vector, or one row
    with a column ``q``. cosine_gap is 1 - dot, for unit vectors."""
    if isinstance(query, DataFrame):
        rows, q = vectors.crossJoin(F.broadcast(query.select("q"))), F.col("q")  # one row
    else:
        rows, q = vectors, F.array(*[F.lit(float(x)) for x in query])
    measures = {"squared_l2": V.squared_l2, "cosine_gap": lambda a, b: F.greatest(F.lit(0.0), 1.0 - V.dot(a, b))}
    near = rows.withColumn("distance", measures[distance](F.col("vector"), q))
    return near.drop("q").orderBy("distance", "id").limit(k)


def vector_scores(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, vector): 1 / (1 + distance) of the nearest rows whose parent chunk may be returned. The
    filter comes after the cut to k, so a narrow filter can leave few hits."""
    kept = hits.join(allowed.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return kept.groupBy("id").agg(F.max(1.0 / (1.0 + F.greatest(F.col("distance"), F.lit(0.0)))).alias("vector"))


def min_max(scores: DataFrame, column: str, out: str) -> DataFrame:
    """scores with ``out``: 0 for the least and 1 for the greatest; 1 for all if they are equal."""
    lo, hi = F.col("__lo"), F.col("__hi")
    ends = scores.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    equal = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
    scaled = F.when(equal, F.lit(1.0)).otherwise((F.col(column) - lo) / (hi - lo))
    return scores.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def fuse(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, query: str, limit: int, hit_rows: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` results. lexical (id, bm25) and dense (id, vector) are scaled to [0, 1]
    each, a missing side counts 0; phrases and pages outside raw get a bonus. hit_rows: rows for ids
    that are no chunks (locators), which win over chunks of the same id."""
    scored = min_max(lexical, "bm25", "__b").join(min_max(dense, "vector", "__v"), "id", "full_outer").na.fill(0.0, ["bm25", "__b", "vector", "__v"])
    body = T.searchable(F.col("title"), F.col("heading"), F.col("tags"), F.col("text"))
    phrase = F.when(F.contains(F.lower(body), F.lit(query.lower())), PHRASE_BONUS).otherwise(0.0)
    # what a result shows of the text is taken before the join, which then shuffles no texts
    columns = ["id", "path", "title", "heading", "type", "tags", "confidence", "is_raw", "start_line", "end_line", phrase.alias("__phrase"), T.snippet(F.col("text"), T.py_tokens(query)).alias("snippet")]
    rows = chunks.select(*columns)
    if hit_rows is not None:
        own = hit_rows.select(*columns)
        rows = own.unionByName(rows.join(own.select("id"), "id", "left_anti"))
    found = scored.join(rows, "id")
    page = F.when(F.coalesce(F.col("is_raw"), F.lit(False)), 0.0).otherwise(PAGE_BONUS)
    score = BM25_WEIGHT * F.col("__b") + VECTOR_WEIGHT * F.col("__v") + F.col("__phrase") + page
    best = found.withColumn("__s", score).where("__s > 0").withColumn("score", F.round("__s", 6))
    best = best.orderBy(F.desc("score"), "path", "start_line", "id").limit(limit)
    blank = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return best.select(
        "id", "path", blank("title", F.col("path")).alias("title"), F.coalesce("heading", F.lit("")).alias("heading"), "score",
        blank("type", F.lit("page")).alias("type"), "tags", "confidence", "snippet",
        F.round("bm25", 6).alias("bm25_score"), F.round("vector", 6).alias("vector_score"), "start_line", "end_line",
        T.read_hint(F.col("path"), F.col("heading"), F.col("start_line"), F.col("end_line")).alias("read_hint"),
    )


def candidates(limit: int) -> int:
    return max(50, 10 * limit)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame | list[float], limit: int = 8, include_raw: bool = False, types: list[str] | None = None, tags: list[str] | None = None, distance: str = "squared_l2") -> DataFrame:
    """chunks and vectors (chunk rows with parent_id and vector) to the best results."""
    allowed = admit(chunks, include_raw, types, tags)
    hits = knn(vectors, query_vector, candidates(limit), distance)
    extra = hits if "path" in vectors.columns else None
    return fuse(bm25(allowed, query), vector_scores(hits, allowed), allowed, query, limit, extra)


def keyword_contributions(chunks: DataFrame, query: str, top: int = 5) -> DataFrame:
    """For each query term the number of chunks that have it and the best of them."""
    parts = term_contributions(chunks, query).withColumn("contribution", F.round("contribution", 6))
    rows = parts.join(chunks.select("id", "path", "heading", "start_line", "end_line"), "id")
    counts = parts.groupBy("term").agg(F.count(F.lit(1)).alias("matching_chunks"))
    order = Window.partitionBy("term").orderBy(F.desc("contribution"), "path", "start_line", "id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    hint = T.read_hint(F.col("path"), F.col("heading"), F.col("start_line"), F.col("end_line"))
    return best.join(F.broadcast(counts), "term").select("term_no", "term", "matching_chunks", "rank", "path", "heading", F.col("contribution").alias("bm25_contribution"), hint.alias("read_hint"))  # a row per query term


def trace(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best of each stage before fusion."""
    top = max(limit, 3)
    one = lexical.orderBy(F.desc("bm25"), "id").limit(top).select(F.lit("bm25").alias("stage"), "id", F.round("bm25", 6).alias("score"))
    two = dense.orderBy(F.desc("vector"), "id").limit(top).select(F.lit("vector").alias("stage"), "id", F.round("vector", 6).alias("score"))
    hint = T.read_hint(F.col("path"), F.col("heading"), F.col("start_line"), F.col("end_line"))
    return one.unionByName(two).join(chunks, "id").select("stage", "id", "path", F.coalesce("heading", F.lit("")).alias("heading"), "score", hint.alias("read_hint"))


def candidate_counts(chunks: DataFrame, allowed: DataFrame, lexical: DataFrame, dense: DataFrame, results: DataFrame) -> DataFrame:
    """One row: how many chunks, admitted ones, lexical and dense hits, and results there are."""
    out = None
    for name, rows in (("chunks_total", chunks), ("chunks_after_filters", allowed), ("bm25_nonzero", lexical), ("vector_hits", dense), ("returned", results)):
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
