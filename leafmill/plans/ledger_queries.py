"""Change ledger, index audit, JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import ledger as L
from ..sources.tables import as_index, as_snapshots, page_path, table
from . import sql as Q


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.diff(*as_snapshots(table(spark, sf_dir, "documents")))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).drop("old_text", "new_text")


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_line_diff(_events(spark, sf_dir)).select("path", "kind", "added_lines", "removed_lines")


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = as_snapshots(table(spark, sf_dir, "documents"))
    events = L.diff(previous, current)
    # every page has one, two or three events behind it
    past = table(spark, sf_dir, "documents").select("doc_id", page_path().alias("path"), F.octet_length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3 + 1)).alias("k"))
    log = past.select("path", (3 * F.col("doc_id") + F.col("k")).alias("id"), F.when(F.col("k") == 1, "added").otherwise("modified").alias("kind"), (F.col("n") * F.col("k")).alias("byte_delta"), (-F.col("k")).alias("line_delta"))
    rows = L.in_order(L.rollup(previous, log, events, current))
    return rows.select("path", "change_count", "last_change_kind", "size_bytes", "line_count", "pending", F.col("last_diff.byte_delta").alias("byte_delta"), F.col("last_diff.abs_line_delta").alias("abs_line_delta"))


def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gate(L.aggregate(_events(spark, sf_dir)), changes=1_000_000, size=10, lines=1_000_000)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return as_index(table(spark, sf_dir, "documents"))


def audit_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, indexed = _index(spark, sf_dir)
    gone = A.only_in(indexed, current, "path").select(F.lit("gone").alias("side"), "path")
    return gone.unionByName(A.only_in(current, indexed, "path").select(F.lit("new").alias("side"), "path"))


def audit_stale_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, indexed = _index(spark, sf_dir)
    return A.stale(current, indexed.dropDuplicates(["path"])).select("path", F.array_join("fields", ",").alias("fields"))


def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.capped(A.duplicates(_index(spark, sf_dir)[1]).select("id")).select("count", F.array_join("ids", ",").alias("ids"))


def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, indexed = _index(spark, sf_dir)
    manifest = spark.range(1).select(F.lit(5).cast("long").alias("pages_indexed"), F.lit(None).cast("long").alias("chunks_indexed"))
    files = indexed.drop("id").dropDuplicates(["path"])
    found = A.audit(current.drop("id"), current.select("id", "path"), manifest, files, indexed.select("id", "path"))
    return found.select("code", "severity", "path", "field", F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("details"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_issues(spark, sf_dir).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


def json_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk objects made of events, with a broken one here and there."""
    n = F.col("event_id").cast("string")
    row = F.concat(F.lit('{"id":'), F.when(F.col("event_id") % 7 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"e'), n, F.lit('"'))), F.lit(',"path":"p.md","tags":'), F.when(F.col("event_id") % 11 == 0, F.lit("5")).otherwise(F.lit('["a"]')), F.lit(',"start_line":'), F.when(F.col("event_id") % 13 == 0, F.lit('"x"')).otherwise(n), F.lit("}"))
    value = F.when(F.col("event_id") % 17 == 0, F.lit('{"id":')).when(F.col("event_id") % 19 == 0, F.lit("[1]")).otherwise(row)
    lines = A.json_lines(table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), value.alias("value")))
    fields = F.when(F.col("error").isNull(), F.array_join(A.bad_chunk_fields(F.col("value")), ","))
    return lines.select("line", "error", fields.alias("fields"))


QUERIES = {f.__name__: f for f in (snapshot_diff, line_diff, ledger_rollup, change_gate, audit_anti_joins, audit_stale_meta, audit_duplicates, audit_issues, audit_summary, json_schema_check)}

_LC = "CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} LIKE '%' || chr(10) THEN 0 ELSE 1 END END"
_DIFF = f"""o AS (SELECT {Q.PATH} AS path, text AS t FROM documents WHERE doc_id % 10 <> 0
), c AS (SELECT {Q.PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0
), ev AS (
  SELECT coalesce(o.path, c.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind, sha256(o.t) AS old_sha256, sha256(c.t) AS new_sha256,
         coalesce(octet_length(encode(o.t)), 0) AS old_size_bytes, coalesce(octet_length(encode(c.t)), 0) AS new_size_bytes, coalesce({_LC.format(t='o.t')}, 0) AS old_line_count, coalesce({_LC.format(t='c.t')}, 0) AS new_line_count
  FROM o FULL JOIN c ON o.path = c.path WHERE o.t IS DISTINCT FROM c.t
), ed AS (SELECT *, new_size_bytes - old_size_bytes AS byte_delta, new_line_count - old_line_count AS line_delta FROM ev)"""
_IDX = f"""r AS (SELECT doc_id, substring(sha256(path || h), 1, 24) AS id, path, size, 1 AS chunks FROM (SELECT doc_id, {Q.PATH} AS path, sha256(text) AS h, octet_length(encode(text)) AS size FROM documents)
), cur AS (SELECT * FROM r WHERE doc_id % 23 <> 0
), idx AS (SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 THEN size + 1 ELSE size END AS size) FROM r WHERE doc_id % 13 <> 0
), idx2 AS (SELECT * FROM idx UNION ALL SELECT * FROM idx WHERE doc_id % 17 = 0)"""
_CAP = "SELECT count(*) AS n, array_to_string(list_sort(list(id))[1:20], ',') AS ids FROM"
_DUP = "(SELECT id FROM idx2 GROUP BY id HAVING count(*) > 1)"
_MISS = "(SELECT id FROM cur EXCEPT SELECT id FROM idx2)"
_EXTRA = "(SELECT id FROM idx2 EXCEPT SELECT id FROM cur)"
_ISSUES = f"""{_IDX}, iss AS (
  SELECT 'indexed_file_missing' AS code, 'high' AS severity, path, NULL::VARCHAR AS field, NULL::VARCHAR AS details FROM (SELECT path FROM idx EXCEPT SELECT path FROM cur)
  UNION ALL SELECT 'markdown_file_unindexed', 'warning', path, NULL, NULL FROM (SELECT path FROM cur EXCEPT SELECT path FROM idx)
  UNION ALL SELECT 'chunk_file_missing_source', 'high', path, NULL, NULL FROM (SELECT path FROM idx2 EXCEPT SELECT path FROM cur)
  UNION ALL SELECT 'manifest_file_stale', 'warning', cur.path, NULL, 'fields=size' FROM cur JOIN idx USING (path) WHERE cur.size <> idx.size
  UNION ALL SELECT 'manifest_invalid_schema', 'high', NULL, 'chunks_indexed', NULL
  UNION ALL SELECT 'manifest_page_count_mismatch', 'warning', NULL, NULL, 'actual=5;expected=' || (SELECT count(*) FROM idx)
  UNION ALL SELECT 'manifest_chunk_count_mismatch', 'high', NULL, NULL, 'actual=0;expected=' || (SELECT count(*) FROM idx2)
  UNION ALL SELECT 'chunk_count_mismatch', 'high', NULL, NULL, 'actual=' || (SELECT count(*) FROM idx2) || ';expected=' || (SELECT count(*) FROM cur) WHERE (SELECT count(*) FROM idx2) <> (SELECT count(*) FROM cur)
  UNION ALL SELECT 'duplicate_chunk_ids', 'high', NULL, NULL, 'count=' || n || ';ids=' || ids FROM ({_CAP} {_DUP}) WHERE n > 0
  UNION ALL SELECT 'markdown_chunks_missing_from_index', 'high', NULL, NULL, 'count=' || n || ';ids=' || ids FROM ({_CAP} {_MISS}) WHERE n > 0
  UNION ALL SELECT 'stale_chunks_in_index', 'high', NULL, NULL, 'count=' || n || ';ids=' || ids FROM ({_CAP} {_EXTRA}) WHERE n > 0
)"""

SQL = {
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM ed",
    "ledger_rollup": f"""WITH {_DIFF}, lg AS (SELECT {Q.PATH} AS path, doc_id % 3 + 1 AS k, octet_length(encode(text)) * (doc_id % 3 + 1) AS byte_delta FROM documents
), ps AS (SELECT path FROM o UNION SELECT path FROM ed UNION SELECT path FROM c
) SELECT ps.path, coalesce(lg.k, 0) + (ed.path IS NOT NULL)::INT AS change_count, CASE WHEN ed.path IS NOT NULL THEN kind WHEN lg.k = 1 THEN 'added' WHEN lg.k > 1 THEN 'modified' END AS last_change_kind,
       CASE WHEN ed.path IS NOT NULL THEN new_size_bytes ELSE octet_length(encode(o.t)) END AS size_bytes, CASE WHEN ed.path IS NOT NULL THEN new_line_count ELSE {_LC.format(t='o.t')} END AS line_count,
       ed.path IS NOT NULL AS pending, CASE WHEN ed.path IS NOT NULL THEN ed.byte_delta ELSE lg.byte_delta END AS byte_delta, CASE WHEN ed.path IS NOT NULL THEN abs(line_delta) ELSE lg.k END AS abs_line_delta
FROM ps LEFT JOIN ed ON ps.path = ed.path LEFT JOIN lg ON ps.path = lg.path LEFT JOIN o ON ps.path = o.path""",
    "change_gate": f"""WITH {_DIFF} SELECT count(*) AS pending_events, count_if(kind = 'added') AS added, count_if(kind = 'modified') AS modified, count_if(kind = 'deleted') AS deleted,
       sum(byte_delta)::BIGINT AS byte_delta, sum(line_delta)::BIGINT AS line_delta, sum(abs(byte_delta))::BIGINT AS abs_byte_delta, sum(abs(line_delta))::BIGINT AS abs_line_delta,
       count(*) > 0 AND (count(*) >= 1000000 OR sum(abs(byte_delta)) >= 10 OR sum(abs(line_delta)) >= 1000000) AS significant_change FROM ed""",
    "audit_anti_joins": f"WITH {_IDX} SELECT 'gone' AS side, path FROM (SELECT path FROM idx EXCEPT SELECT path FROM cur) UNION ALL SELECT 'new', path FROM (SELECT path FROM cur EXCEPT SELECT path FROM idx)",
    "audit_stale_meta": f"WITH {_IDX} SELECT cur.path, 'size' AS fields FROM cur JOIN idx USING (path) WHERE cur.size <> idx.size",
    "audit_duplicates": f"WITH {_IDX} SELECT n AS count, ids FROM ({_CAP} {_DUP}) WHERE n > 0",
    "audit_issues": f"WITH {_ISSUES} SELECT * FROM iss",
    "audit_summary": f"WITH {_ISSUES} SELECT code, severity, count(*) AS issues FROM iss GROUP BY code, severity",
    "json_schema_check": """SELECT event_id AS line, CASE WHEN event_id % 17 = 0 THEN 'invalid JSON' WHEN event_id % 19 = 0 THEN 'not an object' END AS error,
       CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'id' END, CASE WHEN event_id % 11 = 0 THEN 'tags' END,
         CASE WHEN event_id % 13 = 0 THEN 'start_line' END], lambda z: z IS NOT NULL), ',') END AS fields FROM events""",
}
