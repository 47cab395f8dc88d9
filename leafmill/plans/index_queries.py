"""The stored index: build, status, search and explanation over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..sources.store import Store, scratch
from ..sources.tables import as_markdown, table
from . import search_queries as SQ
from . import sql as Q


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """An index of all documents as pages of one chunk, with the given vectors."""
    store = Store(spark, scratch(spark, "index"))
    rows = SQ.pages(spark, sf_dir).withColumn("text_hash", F.sha2("text", 256))
    files = rows.select("path", F.lit(0.0).alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("chunks"))
    I.save(store, rows, SQ.vectors(spark, sf_dir), files, include_raw=True)
    return store


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from conversations, cut, tokenised, embedded and written: what the tables then hold."""
    store = Store(spark, scratch(spark, "index"))
    version = I.build(store, as_markdown(table(spark, sf_dir, "conversations")))
    read = lambda t: store.read(t, version)
    sizes = [("chunks", read("chunks").agg(F.count("*"), F.countDistinct("id"))), ("files", read("files").agg(F.count("*"), F.sum("chunks"))), ("lengths", read("lengths").agg(F.count("*"), F.sum("dl"))), ("postings", read("postings").agg(F.count("*"), F.sum("tf"))), ("vectors", read("vectors").agg(F.count("*"), F.countDistinct("parent_id")))]
    out = None
    for name, df in sizes:
        row = df.toDF("n_rows", "total").select(F.lit(name).alias("name"), "n_rows", F.col("total").cast("long").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.status(_stored(spark, sf_dir)).select("backend", "pages_indexed", "chunks_indexed", "include_raw", "bm25_weight", "vector_weight")


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.Searcher(_stored(spark, sf_dir)).search(SQ.PHRASE, SQ.LIMIT, SQ.query_vector(spark, sf_dir)).drop("tags", "confidence")


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.Searcher(_stored(spark, sf_dir)).bm25(SQ.PHRASE).select("id", F.round("bm25", 6).alias("bm25"))


def search_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope: counts of candidates, and how many rows each list has."""
    row = I.Searcher(_stored(spark, sf_dir)).explain(SQ.QUERY, SQ.LIMIT, SQ.query_vector(spark, sf_dir))
    return row.select("query", F.array_join("tokens", " ").alias("tokens"), "candidates.*", F.transform("trace", lambda t: F.concat_ws(":", t["stage"], t["id"])).alias("__t"), F.array_join(F.transform("keywords", lambda k: F.concat_ws(":", k["term"], k["matching_chunks"].cast("string"))), " ").alias("keywords")).select("*", F.array_join(F.array_sort("__t"), " ").alias("trace")).drop("__t")


QUERIES = {f.__name__: f for f in (index_build, index_status, search_indexed, bm25_indexed, search_explain)}

_BUILT = f"""{Q.SECTIONS}, ch AS (
  SELECT substring(sha256(path || chr(0) || heading || chr(0) || ordinal || chr(0) || sha256(text)), 1, 24) AS id, path, {Q.tok("title || chr(10) || heading || chr(10) || chr(10) || text")} AS t FROM sx
)"""
SQL = {
    "index_build": f"""WITH {_BUILT} SELECT 'chunks' AS name, count(*) AS n_rows, count(DISTINCT id) AS total FROM ch
UNION ALL SELECT 'files', (SELECT count(*) FROM md), count(*) FROM ch UNION ALL SELECT 'lengths', count(*), sum(len(t))::BIGINT FROM ch
UNION ALL SELECT 'postings', sum(len(list_distinct(t)))::BIGINT, sum(len(t))::BIGINT FROM ch UNION ALL SELECT 'vectors', count(*), count(DISTINCT id) FROM ch""",
    "index_status": "SELECT 'parquet' AS backend, count(*) AS pages_indexed, count(*) AS chunks_indexed, true AS include_raw, 0.35::DOUBLE AS bm25_weight, 0.65::DOUBLE AS vector_weight FROM documents",
    "search_indexed": SQ.SQL["hybrid_search"],
    "bm25_indexed": SQ.SQL["bm25_phrase_bonus"],
    "search_explain": f"""SELECT '{SQ.QUERY}' AS query, '{" ".join(dict.fromkeys(SQ.QUERY.split()))}' AS tokens, c.*,
       (SELECT string_agg(term || ':' || n, ' ' ORDER BY term) FROM (SELECT term, any_value(matching_chunks) AS n FROM ({SQ.SQL["keyword_contributions"]}) GROUP BY term)) AS keywords,
       (SELECT string_agg(stage || ':' || id, ' ' ORDER BY stage || ':' || id) FROM ({SQ.SQL["search_trace"]})) AS trace
FROM ({SQ.SQL["candidate_counts"]}) c""",
}
