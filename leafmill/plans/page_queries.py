"""Pages: projection, chunks, grep, reading, sections, text kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import grep as G
from ..operators import read as R
from ..operators import sections as X
from ..sources import corpus
from ..sources.tables import as_markdown, as_pages, table
from . import sql as Q

WORD, REGEX = "idiot", "th[ae] \\w+ing"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(table(spark, sf_dir, "documents"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_markdown(table(spark, sf_dir, "conversations"))


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with code before each turn."""
    return markdown(spark, sf_dir).select("path", F.replace("body", F.lit("## Turn"), F.lit("```py\n## not a heading\n```\n\tcode\n## Turn")).alias("text"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' HTML with Markdown noise in place of its tags."""
    html = F.col("html")
    for a, b in (("<p>", "\n- "), ("</p>", " [a link](http://x.y) [[Page|shown]] `code` ![alt](i.png)\n"), ("<h1>", "\n## ")):
        html = F.replace(html, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("text"))


def page_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = markdown(spark, sf_dir)
    front = F.concat(F.lit("---\nowner: me\n---\n\n"), "text")
    return corpus.parse(md.select("path", front.alias("text")), yaml=False).select("path", "slug", "title", "type", "confidence", "frontmatter_lines", F.length("body").alias("body_chars"), "is_raw")


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(markdown(spark, sf_dir)).select("id", "path", "title", "heading", "level", "text_hash", "start_line", "end_line")


def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grep(documents(spark, sf_dir), WORD, context=1, limit=50)


def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grep(documents(spark, sf_dir), REGEX, regex=True, case_sensitive=True, include_raw=True, limit=100)


def grep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(documents(spark, sf_dir), REGEX, regex=True, case_sensitive=True)


def read_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_heading(C.chunk(markdown(spark, sf_dir)), "Turn 1 (assistant)")


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_range(markdown(spark, sf_dir), 2, 5)


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spans(fenced(spark, sf_dir))


def section_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.replace(markdown(spark, sf_dir), "Turn 0 (user)", "Nothing was said.", strict=False)


def strip_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fenced(spark, sf_dir).select("path", T.strip_code(F.col("text")).alias("prose"), F.round(T.code_line_ratio(F.col("text")), 6).alias("code_line_ratio"))


def strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).select("page_id", T.strip_noise(F.col("text")).alias("prose"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "sentence")


QUERIES = {f.__name__: f for f in (page_projection, chunk_sections, grep_literal, grep_regex, grep_summary, read_heading, read_lines, section_spans, section_replace, strip_code, strip_noise, sentences)}

_LINES = f"""{Q.PAGES}, ln AS (
  SELECT id, path, is_raw, dir_rank, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT *, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM pg)
)"""


def _grep(pattern: str, where: str, context: int, limit: int) -> str:
    return f"""WITH {_LINES}
SELECT path, i::INT AS line, (strpos(ls[i], regexp_extract(ls[i], '{pattern}')))::INT AS "column", regexp_extract(ls[i], '{pattern}') AS match, ls[i] AS line_text,
       greatest(i - {context}, 1)::INT AS context_start_line, least(i + {context}, len(ls))::INT AS context_end_line,
       array_to_string(ls[greatest(i - {context}, 1):least(i + {context}, len(ls))], chr(10)) AS context,
       path || ' lines ' || greatest(i - {context}, 1) || '-' || least(i + {context}, len(ls)) AS read_hint
FROM ln WHERE {where} AND regexp_matches(ls[i], '{pattern}') ORDER BY dir_rank, path, i LIMIT {limit}"""


_FENCED = f"""{Q.MARKDOWN}, fe AS (
  SELECT path, replace(body, '## Turn', '```py' || chr(10) || '## not a heading' || chr(10) || '```' || chr(10) || chr(9) || 'code' || chr(10) || '## Turn') AS text FROM md
), fl AS (
  SELECT path, ls[i] AS line, i, len(ls) AS n, ls[i] LIKE '```%' AS fence FROM (
    SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, chr(10))[:-2] AS ls FROM fe))
), fs AS (SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY i) AS seen FROM fl)"""
_STRIP = r"'^\s+|\s+$', '', 'g'"

SQL = {
    "page_projection": f"""WITH {Q.MARKDOWN} SELECT path, replace(split_part(path, '/', 2), '.md', '') AS slug, title, 'query' AS type, NULL::VARCHAR AS confidence,
       4 AS frontmatter_lines, length(body)::INT AS body_chars, false AS is_raw FROM md""",
    "chunk_sections": f"""WITH {Q.SECTIONS}
SELECT substring(sha256(path || chr(0) || heading || chr(0) || ordinal || chr(0) || sha256(text)), 1, 24) AS id, path, title, heading, level, sha256(text) AS text_hash, start_line, end_line FROM sx""",
    "grep_literal": _grep(f"(?i){WORD}", "NOT is_raw", 1, 50),
    "grep_regex": _grep(REGEX, "true", 2, 100),
    "grep_summary": f"""WITH {_LINES} SELECT (SELECT count(*) FROM pg WHERE NOT is_raw) AS searched_files, count_if(regexp_matches(ls[i], '{REGEX}')) AS total_matches,
       least(count_if(regexp_matches(ls[i], '{REGEX}')), 100) AS count, count_if(regexp_matches(ls[i], '{REGEX}')) > 100 AS truncated FROM ln WHERE NOT is_raw""",
    "read_heading": f"WITH {Q.SECTIONS} SELECT path, title, heading, text AS content, start_line, end_line FROM sx WHERE heading = 'Turn 1 (assistant)' QUALIFY row_number() OVER (PARTITION BY path ORDER BY ordinal) = 1",
    "read_lines": f"WITH {Q.MARKDOWN} SELECT path, title, array_to_string(string_split(body, chr(10))[2:5], chr(10)) AS content, 2 AS start_line, 5 AS end_line FROM md",
    "section_spans": rf"""WITH {_FENCED}, hd AS (
  SELECT path, i, n, trim(regexp_extract(line, '^#{{1,6}}[ \t]+(.*)$', 1)) AS heading, length(regexp_extract(line, '^(#+)', 1)) AS level
  FROM fs WHERE NOT fence AND seen % 2 = 0 AND regexp_matches(line, '^#{{1,6}}[ \t]+\S')
) SELECT a.path, a.heading, a.level::INT AS level, a.i::INT AS start_line,
         (coalesce((SELECT min(b.i) FROM hd b WHERE b.path = a.path AND b.i > a.i AND b.level <= a.level), a.n + 1) - 1)::INT AS end_line,
         row_number() OVER (PARTITION BY a.path, a.heading ORDER BY a.i)::INT AS occurrence FROM hd a""",
    "section_replace": f"""WITH {Q.SECTIONS}, tg AS (
  SELECT path, start_line AS i FROM sx WHERE heading = 'Turn 0 (user)' QUALIFY count(*) OVER (PARTITION BY path) = 1
), nx AS (SELECT tg.path, tg.i, (SELECT min(start_line) FROM sx WHERE sx.path = tg.path AND sx.start_line > tg.i AND level <= 2) AS stop FROM tg
), ls AS (SELECT nx.*, string_split(body, chr(10))[:-2] AS ls FROM nx JOIN md USING (path)
), lt AS (SELECT *, list_max(list_filter(range(i, coalesce(stop, len(ls) + 1)), lambda k: k = i OR regexp_matches(ls[k], '\\S'))) AS last FROM ls
) SELECT path, 'Turn 0 (user)' AS heading, i::INT AS start_line, last::INT AS end_line, array_to_string(ls[i:last], chr(10)) AS old_section, ls[i] || chr(10) || 'Nothing was said.' AS new_section,
         regexp_replace(array_to_string(list_concat(list_concat(ls[1:i - 1], [ls[i] || chr(10) || 'Nothing was said.']), ls[last + 1:]), chr(10)), '[\\r\\n]+$', '') || chr(10) AS text FROM lt""".replace("\\\\", "\\"),
    "strip_code": f"""WITH {_FENCED} SELECT path,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fence AND seen % 2 = 0 AND line NOT LIKE '    %' AND line NOT LIKE chr(9) || '%'), '') AS prose,
       round(count(*) FILTER (WHERE fence OR seen % 2 = 1 OR line LIKE '    %' OR line LIKE chr(9) || '%') / count(*), 6) AS code_line_ratio FROM fs GROUP BY path""",
    "strip_noise": r"""WITH t AS (
  SELECT page_id, replace(replace(replace(html, '<p>', chr(10) || '- '), '</p>', ' [a link](http://x.y) [[Page|shown]] `code` ![alt](i.png)' || chr(10)), '<h1>', chr(10) || '## ') AS x FROM pages
), u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '`([^`\n]+)`', ' ', 'g'), '!\[[^\]]*\]\([^\)]*\)', ' ', 'g'), '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', '\1', 'g') AS x FROM t
) SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^\s*(?:[-*+] |\d+[.)] )', '', 'g') AS prose FROM u""",
    "sentences": rf"""WITH c AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, {_STRIP}), '\s+', ' ', 'g') AS k FROM documents
), p AS (SELECT doc_id, text, k, string_split(regexp_replace(k, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM c
), q AS (SELECT doc_id, CASE WHEN len(s) = 1 THEN regexp_split_to_array(text, '\n+|;\s+') ELSE s END AS s FROM p WHERE k <> ''
), r AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS s FROM q
) SELECT doc_id, i - 1 AS n, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM r)""",
}
