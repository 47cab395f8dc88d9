"""Fragments of the comparison SQL."""

from __future__ import annotations

TOKEN = r"[A-Za-z0-9_./:\\-]+|[가-힣]+"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t))"


FOLDER = "['entities', 'concepts', 'comparisons', 'queries', 'raw'][(doc_id % 5 + 1)::INT]"
PATH = f"{FOLDER} || '/doc-' || doc_id || '.md'"
KIND = "['entity', 'concept', 'comparison', 'query', 'raw'][(doc_id % 5 + 1)::INT]"

#: Pages as ``as_pages`` makes them; body is the searchable text.
PAGES = f"""pg AS (
  SELECT *, title || chr(10) || heading || chr(10) || array_to_string(tags, ' ') || chr(10) || text AS body
  FROM (SELECT doc_id, doc_id::VARCHAR AS id, {PATH} AS path, 'doc-' || doc_id AS slug, 'Document ' || doc_id AS title,
               {KIND} AS type, [lang, source] AS tags, 'Document ' || doc_id AS heading, text, doc_id % 5 = 4 AS is_raw,
               1 AS start_line, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS end_line, (doc_id % 5)::INT AS dir_rank
        FROM documents)
)"""

MARKDOWN = """md AS (
  SELECT 'queries/conv-' || conv_id || '.md' AS path, 'Conversation ' || conv_id AS title,
         '# Conversation ' || conv_id || chr(10) || chr(10)
           || string_agg('## Turn ' || turn || ' (' || role || ')' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS body
  FROM conversations GROUP BY conv_id
)"""

#: Sections of the Markdown pages, by line.
SECTIONS = MARKDOWN + r""", st AS (
  SELECT path, title, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM md
), li AS (
  SELECT path, title, ls[i] AS line, i, len(ls) AS n FROM (
    SELECT path, title, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, title, string_split(body, chr(10)) AS ls FROM st))
), fl AS (
  SELECT *, regexp_matches(line, '^#{1,6}\s+\S') AS head, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS sec FROM li
), se AS (
  SELECT path, any_value(title) AS title, sec - 1 AS ordinal, min(i) AS start_line, max(i) AS end_line,
         regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text, first(line ORDER BY i) AS headline
  FROM fl WHERE sec > 0 GROUP BY path, sec
), sx AS (
  SELECT path, title, ordinal::INT AS ordinal, start_line::INT AS start_line, end_line::INT AS end_line, text,
         regexp_replace(regexp_extract(headline, '^#{1,6}\s+(.*)$', 1), '\s+$', '') AS heading,
         length(regexp_extract(headline, '^(#{1,6})\s', 1))::INT AS level FROM se
)"""

BM25_TERM = """CASE WHEN {f} > 0 THEN ln(1.0::DOUBLE + (n - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) * ({f} * 2.5::DOUBLE
  / ({f} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(len(t), 1) / greatest(avgdl, 1e-9::DOUBLE)))) ELSE 0 END"""


def bm25(query: str, where: str = "true", phrase: bool = True) -> str:
    """CTEs tk (pages with tokens), stt and bm (id, bm25)."""
    terms = query.lower().split()
    unique = list(dict.fromkeys(terms))
    f = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    df = ", ".join(f"count_if(list_contains(t, '{w}')) AS df{i}" for i, w in enumerate(unique))
    parts = [BM25_TERM.format(f=f(w), df=f"df{unique.index(w)}") for w in terms]
    score = "CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END".format(f"contains(lower(body), '{query.lower()}')" if phrase else "false")
    for p in parts:
        score = f"({p}) + {score}"
    return f"""tk AS (SELECT *, {tok('body')} AS t FROM pg WHERE {where}
), stt AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, {df} FROM tk
), bm AS (SELECT * FROM (SELECT id, {score} AS bm25 FROM tk, stt) WHERE bm25 > 0)"""


def knn(query_id: int, k: int) -> str:
    """CTE kn (id, distance), the nearest by squared distance."""
    return f"""qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {query_id}
), kn AS (
  SELECT vec_id::VARCHAR AS id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i]))) AS distance
  FROM embeddings, qv ORDER BY distance, id LIMIT {k}
)"""


def min_max(cte: str, column: str) -> str:
    return f"""SELECT id, {column}, CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(lo), abs(hi)) THEN 1.0::DOUBLE ELSE ({column} - lo) / (hi - lo) END AS scaled
  FROM {cte}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {cte})"""
