"""Markdown page trees: scanning, front matter, projection to page rows."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

FOLDERS = ("entities", "concepts", "comparisons", "queries")
RAW = "raw"
STORE = ".vector"
_KINDS = {"entities": "entity", "concepts": "concept", "comparisons": "comparison", "queries": "query", "raw": "raw"}
_FILE = "path string, text string, size long, mtime double, dir_rank int"


def list_pages(root: str | Path, include_raw: bool = False) -> list[tuple[str, int, float, int]]:
    """(path, size, mtime, folder rank) in scan order: folder by folder, sorted inside. Files at the
    root and anything below a store folder are no pages."""
    base, out = Path(root), []
    for rank, folder in enumerate((*FOLDERS, RAW) if include_raw else FOLDERS):
        found = []
        for top, _, names in os.walk(base / folder):
            rel = Path(top).relative_to(base)
            if STORE in rel.parts:
                continue
            found += [rel / n for n in names if n.endswith(".md")]
        for rel in sorted(found):
            stat = (base / rel).stat()
            out.append((rel.as_posix(), stat.st_size, stat.st_mtime, rank))
    return out


def scan(spark: SparkSession, root: str | Path, include_raw: bool = False) -> DataFrame:
    """Pages of a file tree that the driver and the executors mount: path, text, size, mtime,
    dir_rank. Only the listing is the driver's; the files are read in tasks, with line ends
    translated. For a tree in an object store see ``scan_store``."""
    base = str(Path(root))
    listed = spark.createDataFrame(list_pages(root, include_raw), "path string, size long, mtime double, dir_rank int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Path(base, p).read_text("utf-8") for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), b.column("size"), b.column("mtime"), b.column("dir_rank")], names=["path", "text", "size", "mtime", "dir_rank"])

    return listed.mapInArrow(read, _FILE)


def scan_store(spark: SparkSession, root: str, include_raw: bool = False) -> DataFrame:
    """The same rows with Spark's own reader, from any file system. It leaves out names that begin
    with _ or a dot, and modification times are in milliseconds."""
    base = root.rstrip("/") + "/"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    path = F.substring_index(F.col("_metadata.file_path"), base.split("://")[-1], -1)
    rows = files.select(
        F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
        F.col("_metadata.file_size").alias("size"), (F.unix_millis("_metadata.file_modification_time") / 1000.0).alias("mtime"),
    )
    wanted = (*FOLDERS, RAW) if include_raw else FOLDERS
    rank = F.array_position(F.array(*[F.lit(f) for f in wanted]), F.substring_index("path", "/", 1)) - 1
    kept = rows.where(F.contains("path", F.lit("/")) & ~F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{STORE}/")))
    return kept.withColumn("dir_rank", rank.cast("int")).where("dir_rank >= 0")


def _front_json(raw: str | None) -> str:
    """The front matter as a JSON object; anything but a mapping is an empty one."""
    if not raw or not raw.strip():
        return "{}"
    import yaml

    data = yaml.safe_load(raw)
    return json.dumps(data if isinstance(data, dict) else {}, default=str, ensure_ascii=False)


@F.pandas_udf(StringType())
def front_json(raw: pd.Series) -> pd.Series:
    return raw.map(_front_json)


def split_front(text: Column) -> Column:
    """struct<raw, body, lines> of a page's text. Front matter begins with a line of three dashes and
    ends at the next line that begins with them; line feeds before the body are dropped."""
    end = F.locate("\n---", text, 5)
    has = text.startswith("---\n") & (end > 0)
    body = F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\n+", "")
    lines = T.newline_count(F.substring(text, F.lit(1), F.length(text) - F.length(body)))
    return F.struct(
        F.when(has, F.substring(text, F.lit(5), F.greatest(end - 5, F.lit(0)))).alias("raw"),
        F.when(has, body).otherwise(text).alias("body"),
        F.when(has, lines).otherwise(F.lit(0)).cast("int").alias("lines"),
    )


def kind_of(path: Column) -> Column:
    """The page type that a folder anywhere in the path stands for."""
    parts, out = F.split(path, "/"), F.lit("page")
    for folder, kind in reversed(_KINDS.items()):
        out = F.when(F.array_contains(parts, folder), kind).otherwise(out)
    return out


def parse(files: DataFrame, yaml: bool = True) -> DataFrame:
    """files (path, text, ...) to pages (DOCUMENT). yaml=False leaves front matter unread, for
    tables that have none; the plan then has no Python in it."""
    rows = files.withColumn("__f", split_front(F.col("text")))
    if yaml:
        rows = rows.withColumn("frontmatter", F.when(F.col("__f.raw").isNull(), F.lit("{}")).otherwise(front_json(F.col("__f.raw"))))
    else:
        rows = rows.withColumn("frontmatter", F.lit("{}"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    filled = lambda c: F.when(c != "", c)
    first = F.trim(F.regexp_extract(F.col("__f.body"), r"(?md)^# (.*)$", 1))
    tags = field("tags")
    several = F.from_json(tags, "array<string>")
    front = {"title": filled(field("title")), "type": filled(field("type"))}
    return rows.select(
        "path", stem.alias("slug"),
        F.coalesce(front["title"], filled(first), stem).alias("title"),
        F.coalesce(front["type"], kind_of(F.col("path"))).alias("type"),
        F.when(tags.isNull() | (tags == ""), F.array().cast("array<string>")).when(tags.startswith("["), several).otherwise(F.array(tags)).alias("tags"),
        field("confidence").alias("confidence"), "frontmatter", F.col("__f.lines").alias("frontmatter_lines"), F.col("__f.body").alias("body"), "text",
        F.col("path").startswith("raw/").alias("is_raw"),
        *[c for c in ("size", "mtime", "dir_rank") if c in files.columns],
    )
