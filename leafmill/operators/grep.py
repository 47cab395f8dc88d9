"""Literal and regular-expression search in pages, line by line, with context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def java_pattern(pattern: str, regex: bool = False, case_sensitive: bool = False) -> str:
    """The pattern for Spark's engine; what Python rejects is refused, so that a typing error does
    not reach the executors. The dialects agree but for rarities such as named groups."""
    if not pattern:
        raise ValueError("pattern must be a non-empty string")
    if regex:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid regular expression: {e}") from e
        body = pattern
    else:
        body = re.sub(r"([\\.^$|?*+()\[\]{}#&~-])", r"\\\1", pattern)
    return body if case_sensitive else f"(?iu){body}"


def _check(context: int, limit: int) -> None:
    if context < 0:
        raise ValueError("context must be >= 0")
    if limit < 1:
        raise ValueError("limit must be >= 1")


def hits(pages: DataFrame, pattern: str, context: int = 2) -> DataFrame:
    """One row per matching line of pages (dir_rank, path, text); pattern from java_pattern.

    Lines stay an array of their page: matching lines are filtered in place and cut out with their
    neighbours, so that only hits become rows.
    """
    rows = pages.select("dir_rank", "path", T.lines(F.col("text")).alias("ls"))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.element_at("ls", i).rlike(pattern))
    found = rows.where(F.size("ls") > 0).select("dir_rank", "path", "ls", F.explode(at).alias("line"))
    text: Column = F.element_at("ls", F.col("line"))
    first = F.greatest(F.col("line") - context, F.lit(1))
    last = F.least(F.col("line") + context, F.size("ls"))
    # text in front of the match, in code points
    before = F.regexp_extract(text, f"^(.*?)(?:{pattern})", 1)
    return found.select(
        "dir_rank", "path", "line",
        (F.length(before) + 1).alias("column"),
        F.regexp_substr(text, F.lit(pattern)).alias("match"),
        text.alias("line_text"),
        first.alias("context_start_line"),
        last.alias("context_end_line"),
        F.array_join(F.slice("ls", first, last - first + 1), "\n").alias("context"),
        T.read_hint(F.col("path"), F.lit(None).cast("string"), first, last).alias("read_hint"),
    )


def grep(pages: DataFrame, pattern: str, *, include_raw: bool = False, regex: bool = False, case_sensitive: bool = False, context: int = 2, limit: int = 100) -> DataFrame:
    """The first ``limit`` matching lines in scan order."""
    _check(context, limit)
    rows = pages if include_raw else pages.where(~F.col("is_raw"))
    return hits(rows, java_pattern(pattern, regex, case_sensitive), context).orderBy("dir_rank", "path", "line").limit(limit).drop("dir_rank")


def summary(pages: DataFrame, pattern: str, *, include_raw: bool = False, regex: bool = False, case_sensitive: bool = False, limit: int = 100) -> DataFrame:
    """One row: pages searched, matching lines in all, lines returned under the limit."""
    _check(0, limit)
    rows = pages if include_raw else pages.where(~F.col("is_raw"))
    java = java_pattern(pattern, regex, case_sensitive)
    per_page = F.size(F.filter(T.lines(F.col("text")), lambda x: x.rlike(java)))
    counted = rows.agg(F.count(F.lit(1)).alias("searched_files"), F.coalesce(F.sum(per_page), F.lit(0)).alias("total_matches"))
    return counted.withColumn("count", F.least("total_matches", F.lit(limit))).withColumn("truncated", F.col("total_matches") > F.col("count"))
