"""Consistency of an index with its sources: one DataFrame of issues per rule, then their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ISSUE

CAP = 20


def issue(rows: DataFrame, code: str, severity: str, message: str, path: Column | None = None, field: Column | None = None, **details: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    pairs = [x for k, c in details.items() for x in (F.lit(k), c.cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.lit(None)
    return rows.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), (none if path is None else path).alias("path"),
        (none if field is None else field.cast("string")).alias("field"), held.cast("map<string,string>").alias("details"),
    )


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks, each once."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, fields): files that both sides have under other figures. Both: path, size, chunks and
    perhaps mtime, which may differ by a microsecond."""
    b = indexed.select("path", *[F.col(c).alias(f"i_{c}") for c in ("size", "chunks", "mtime") if c in indexed.columns])
    both = current.join(b, "path")
    parts = [F.when(F.col("size") != F.col("i_size"), F.lit("size")), F.when(F.col("chunks") != F.col("i_chunks"), F.lit("chunks"))]
    if "i_mtime" in b.columns:
        parts.append(F.when(F.abs(F.col("mtime") - F.col("i_mtime")) > 1e-6, F.lit("mtime")))
    return both.withColumn("fields", F.filter(F.array(*parts), lambda x: x.isNotNull())).where(F.size("fields") > 0).select("path", "fields")


def duplicates(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def capped(ids: DataFrame, key: str = "id") -> DataFrame:
    """One row, if there are ids: the first twenty in order, and how many there are. Only the first
    twenty travel; the rest are counted where they are."""
    first = ids.orderBy(key).limit(CAP).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return ids.agg(F.count(F.lit(1)).alias("count")).crossJoin(first).where("count > 0")  # one row each


def counts_differ(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (expected, actual) if two one-column counts differ."""
    e, a = expected.toDF("expected"), actual.toDF("actual")
    return e.crossJoin(a).where(~F.col("expected").eqNullSafe(F.col("actual")))  # one row each


def rows_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def bad_chunk_fields(value: Column) -> Column:
    """Names of the fields of a chunk, given as a JSON object's text, that have a wrong type."""
    v = F.try_parse_json(value)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    absent = lambda f: kind(f).isNull() | (kind(f) == "VOID")
    whole = lambda f: (kind(f) == "BIGINT") | kind(f).startswith("DECIMAL") & text(f).rlike(r"^-?\d+(\.0*)?$") | (kind(f) == "STRING") & text(f).rlike(r"^\s*[+-]?\d+\s*$")
    checks = [(f, (kind(f) != "STRING") | absent(f) | (F.trim(text(f)) == "")) for f in ("id", "path")]
    checks += [(f, ~absent(f) & (kind(f) != "STRING")) for f in ("title", "heading", "type", "text")]
    checks.append(("tags", ~absent("tags") & ~kind("tags").isin("ARRAY<STRING>", "ARRAY<VOID>")))
    checks += [(f, ~absent(f) & ~whole(f)) for f in ("start_line", "end_line")]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(f)) for f, bad in checks]), lambda x: x.isNotNull())


def json_lines(lines: DataFrame) -> DataFrame:
    """lines (line, value) with ``error`` where a line that is not blank is no JSON object."""
    kept = lines.where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    shape = F.schema_of_variant(parsed)
    return kept.withColumn("error", F.when(parsed.isNull(), "invalid JSON").when(~shape.startswith("OBJECT"), "not an object"))


def audit(
    pages: DataFrame, chunks: DataFrame, manifest: DataFrame | None, manifest_files: DataFrame | None, indexed: DataFrame | None,
    vector_rows: DataFrame | None = None, expected_vector_rows: DataFrame | None = None,
) -> DataFrame:
    """Issues of an index. pages (path, size, chunks, mtime) and chunks (id, path) are the sources as
    they are; manifest (pages_indexed, chunks_indexed), manifest_files (as pages) and indexed (id,
    path) what the index says; the last two are one-row counts. None: that part is missing."""
    spark: SparkSession = pages.sparkSession
    one = spark.range(1)
    found: list[DataFrame] = []
    add = lambda *a, **b: found.append(issue(*a, **b))
    files = manifest_files if manifest_files is not None else pages.limit(0)
    rows = indexed if indexed is not None else chunks.select("id", "path").limit(0)
    if manifest is None:
        add(one, "manifest_missing", "high", "The index has no manifest.")
    if indexed is None:
        add(one, "chunks_file_missing", "high", "The index has no chunk table.")
    add(only_in(files, pages, "path"), "indexed_file_missing", "high", "The manifest lists a page that is gone.", path=F.col("path"))
    add(only_in(pages, files, "path"), "markdown_file_unindexed", "warning", "A page is not in the manifest.", path=F.col("path"))
    add(only_in(rows, pages, "path"), "chunk_file_missing_source", "high", "The chunk table has rows of a page that is gone.", path=F.col("path"))
    add(stale(pages, files), "manifest_file_stale", "warning", "The manifest's figures for a page are out of date.", path=F.col("path"), fields=F.array_join("fields", ","))
    count, sides = rows_of(rows), {"expected": F.col("expected"), "actual": F.col("actual")}
    if manifest is not None:
        bad = manifest.select(F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("pages_indexed", "chunks_indexed")])).alias("f")).where("f IS NOT NULL")
        add(bad, "manifest_invalid_schema", "high", "A count in the manifest is no whole number.", field=F.col("f"))
        add(counts_differ(rows_of(files), manifest.select(F.coalesce("pages_indexed", F.lit(0)))), "manifest_page_count_mismatch", "warning", "The manifest counts other pages than it lists.", **sides)
        add(counts_differ(count, manifest.select(F.coalesce("chunks_indexed", F.lit(0)))), "manifest_chunk_count_mismatch", "high", "The manifest counts other chunks than the table has.", **sides)
    add(counts_differ(rows_of(chunks), count), "chunk_count_mismatch", "high", "The pages have other chunks than the table.", **sides)
    shown = {"ids": F.array_join("ids", ","), "count": F.col("count")}
    add(capped(duplicates(rows).select("id")), "duplicate_chunk_ids", "high", "The chunk table has ids twice.", **shown)
    add(capped(only_in(chunks, rows, "id")), "markdown_chunks_missing_from_index", "high", "Chunks of the pages are not in the table.", **shown)
    add(capped(only_in(rows, chunks, "id")), "stale_chunks_in_index", "high", "The table has chunks that no page makes.", **shown)
    if vector_rows is None and expected_vector_rows is not None:
        add(one, "lancedb_table_unavailable", "warning", "The vector table can't be opened.")
    elif vector_rows is not None and expected_vector_rows is not None:
        add(counts_differ(expected_vector_rows, vector_rows), "vector_row_count_mismatch", "high", "The vector table has other rows than the chunks ask for.", **sides)
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], ISSUE))


def summary(
    issues: DataFrame, pages: DataFrame, chunks: DataFrame, manifest: DataFrame | None, manifest_files: DataFrame | None, indexed: DataFrame | None,
    vector_rows: DataFrame | None = None, expected_vector_rows: DataFrame | None = None,
) -> DataFrame:
    """One row: ok, the number of issues, and what each side counts; 0 for a part that is missing,
    null for missing vector rows."""
    one = issues.agg((F.count(F.lit(1)) == 0).alias("ok"), F.count(F.lit(1)).alias("issue_count"))
    for name, rows in (("markdown_pages", pages), ("markdown_chunks", chunks), ("manifest_file_entries", manifest_files), ("chunk_file_chunks", indexed), ("lancedb_rows", vector_rows)):
        n = F.lit(None if name == "lancedb_rows" else 0).cast("long").alias(name)
        one = one.withColumn(name, n) if rows is None else one.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    for name, source in (("manifest_pages", "pages_indexed"), ("manifest_chunks", "chunks_indexed")):
        one = one.withColumn(name, F.lit(0).cast("long")) if manifest is None else one.crossJoin(manifest.select(F.coalesce(source, F.lit(0)).cast("long").alias(name)))
    if expected_vector_rows is None:
        return one.withColumn("expected_vector_rows", F.lit(None).cast("long"))
    return one.crossJoin(expected_vector_rows.toDF("expected_vector_rows"))


def file_issues(manifest_text: DataFrame | None, chunk_lines: DataFrame | None) -> DataFrame:
    """Issues of an index kept as JSON files: manifest_text (one row, value) and chunk_lines (line,
    value). What can't be parsed, is no object, or has fields of a wrong type is an issue each."""
    found: list[DataFrame] = []
    spark = (manifest_text if manifest_text is not None else chunk_lines).sparkSession
    if manifest_text is not None:
        v = F.try_parse_json("value")
        rows = manifest_text.select("value", v.alias("v"), F.schema_of_variant(v).alias("shape"))
        broken = rows.where(F.col("v").isNull() | ~F.col("shape").startswith("OBJECT"))
        found.append(issue(broken, "manifest_invalid_json", "high", "The manifest is no JSON object."))
        whole = rows.where(F.col("shape").startswith("OBJECT"))
        kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
        wrong = [("include_raw", ~kind("include_raw").isin("BOOLEAN")), ("files", ~kind("files").startswith("OBJECT"))]
        wrong += [(f, ~(kind(f) == "BIGINT") & ~F.coalesce(F.try_variant_get("v", f"$.{f}", "string").rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))) for f in ("pages_indexed", "chunks_indexed")]
        bad = whole.select(F.explode(F.array(*[F.when(kind(f).isNotNull() & c, F.lit(f)) for f, c in wrong])).alias("f")).where("f IS NOT NULL")
        found.append(issue(bad, "manifest_invalid_schema", "high", "A field of the manifest has a wrong type.", field=F.col("f")))
        files = whole.where(kind("files").startswith("OBJECT")).select(F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.files", "variant")), "map<string,string>")).alias("path", "entry"))
        e = F.try_parse_json("entry")
        number = lambda f: F.try_variant_get(e, f"$.{f}", "string").cast("string").rlike(r"^\s*[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\s*$")
        object_ = F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False))
        odd = F.filter(F.array(*[F.when(~F.coalesce(number(f), F.lit(False)), F.lit(f)) for f in ("size", "chunks", "mtime")]), lambda x: x.isNotNull())
        fields = files.select("path", F.when(object_, odd).alias("fields")).where("fields IS NULL OR size(fields) > 0")
        found.append(issue(fields, "manifest_file_invalid_schema", "high", "A page's entry in the manifest is no object with numbers.", path=F.col("path"), fields=F.array_join("fields", ",")))
    if chunk_lines is not None:
        lines = json_lines(chunk_lines)
        found.append(issue(lines.where("error IS NOT NULL"), "chunks_file_invalid_json", "high", "A line of the chunk file is no JSON object.", line=F.col("line"), error=F.col("error")))
        wrong = lines.where("error IS NULL").withColumn("fields", bad_chunk_fields(F.col("value"))).where(F.size("fields") > 0)
        found.append(issue(wrong, "chunks_file_invalid_schema", "high", "A row of the chunk file has fields of a wrong type.", line=F.col("line"), fields=F.array_join("fields", ",")))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], ISSUE))
