"""Heading chunks with line spans, and token-budget locators inside long chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_MARK = "\x01"
_PAGE = ("path", "slug", "title", "type", "tags", "confidence")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sections_of(body: Column) -> Column:
    """array<struct<ordinal, text, heading, level, start, end>> of a stripped body's headings.

    The body is split in front of its heading lines; a piece's line is the count of line feeds in
    the pieces before it, carried along by a fold, so that a page stays one row and needs no window.
    Text before the first heading is left out.
    """
    pieces = F.split(F.regexp_replace(body, T.HEADING, f"{_MARK}$0"), _MARK)
    empty = F.array().cast("array<struct<text:string,start:int>>")
    first = F.struct(F.lit(1).alias("line"), empty.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        item = F.struct(piece.alias("text"), acc["line"].alias("start"))
        return F.struct((acc["line"] + T.newline_count(piece)).cast("int").alias("line"), F.array_append(acc["out"], item).alias("out"))

    placed = F.filter(F.aggregate(pieces, first, step, lambda acc: acc["out"]), lambda p, i: i > 0)

    def row(p: Column, i: Column) -> Column:
        raw = p["text"]
        inner = T.newline_count(F.substring(raw, F.lit(1), F.greatest(F.length(raw) - 1, F.lit(0))))
        return F.struct(
            i.alias("ordinal"),
            _strip(raw).alias("text"),
            F.trim(F.regexp_extract(raw, T.HEADING, 2)).alias("heading"),
            F.length(F.regexp_extract(raw, r"^(#{1,6})\s", 1)).alias("level"),
            p["start"].alias("start"),
            (p["start"] + inner).alias("end"),
        )

    return F.transform(placed, row)


def chunk(pages: DataFrame) -> DataFrame:
    """Pages (DOCUMENT) to chunks (CHUNK, with ordinal). A page without headings is one chunk of
    level 0 under its title; an empty page has none."""
    body = pages.withColumn("__body", _strip(F.col("body"))).where(F.col("__body") != "")
    whole = F.array(F.struct(
        F.lit(0).alias("ordinal"), F.col("__body").alias("text"), F.col("title").alias("heading"), F.lit(0).alias("level"),
        F.lit(1).alias("start"), (T.newline_count(F.col("__body")) + 1).cast("int").alias("end"),
    ))
    found = sections_of(F.col("__body"))
    parts = F.when(F.regexp_count(F.col("__body"), F.lit(T.HEADING)) > 0, found).otherwise(whole)
    rows = body.select(*_PAGE, "frontmatter_lines", F.explode(parts).alias("s")).where("s.text != ''")
    digest = F.sha2("s.text", 256)
    zero = F.lit("\0")
    key = F.concat(F.col("path"), zero, F.col("s.heading"), zero, F.col("s.ordinal").cast("string"), zero, digest)
    return rows.select(
        F.substring(F.sha2(key, 256), 1, 24).alias("id"), *_PAGE,
        F.col("s.heading").alias("heading"), F.col("s.level").alias("level"), F.col("s.text").alias("text"),
        F.col("path").startswith("raw/").alias("is_raw"), digest.alias("text_hash"),
        (F.col("s.start") + F.col("frontmatter_lines")).cast("int").alias("start_line"),
        (F.col("s.end") + F.col("frontmatter_lines")).cast("int").alias("end_line"),
        F.col("s.ordinal").alias("ordinal"),
    )


def searchable(chunks: DataFrame) -> Column:
    return T.searchable(chunks["title"], chunks["heading"], chunks["tags"], chunks["text"])


def _packed(text: Column, start: Column, limit: int) -> Column:
    """Lines packed into runs of at most ``limit`` tokens: array<struct<first, last, text>>.

    A fold over the lines: a line that would overflow closes the run before it, a full run closes
    at once, blank lines only count as numbers.
    """
    line_rows = F.transform(T.lines(text), lambda x, i: F.struct(x.alias("line"), (start + i).cast("int").alias("no"), F.size(T.tokens(x)).alias("n")))
    line_rows = F.filter(line_rows, lambda r: F.trim(F.regexp_replace(r["line"], r"\s", "")) != "")
    run = "struct<first:int,last:int,text:string>"
    empty = F.struct(F.array().cast(f"array<{run}>").alias("out"), F.lit(None).cast(run).alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, r: Column) -> Column:
        over = acc["run"].isNotNull() & (acc["n"] + r["n"] > limit)
        out = F.when(over, F.array_append(acc["out"], acc["run"])).otherwise(acc["out"])
        fresh = over | acc["run"].isNull()
        now = F.when(fresh, F.struct(r["no"].alias("first"), r["no"].alias("last"), r["line"].alias("text"))).otherwise(
            F.struct(acc["run"]["first"].alias("first"), r["no"].alias("last"), F.concat(acc["run"]["text"], F.lit("\n"), r["line"]).alias("text"))
        )
        n = F.when(fresh, r["n"]).otherwise(acc["n"] + r["n"])
        full = n >= limit
        return F.struct(
            F.when(full, F.array_append(out, now)).otherwise(out).alias("out"),
            F.when(~full, now).alias("run"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    close = lambda acc: F.when(acc["run"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["run"]))
    runs = F.aggregate(line_rows, empty, step, close)
    stripped = F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), _strip(r["text"]).alias("text")))
    return F.filter(stripped, lambda r: r["text"] != "")


def locators(chunks: DataFrame, max_tokens: int | None) -> DataFrame:
    """Rows to embed: a chunk itself, or the runs of lines of one that is longer than max_tokens."""
    base = F.array(F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.col("text").alias("text")))
    if max_tokens is None or max_tokens <= 0:
        parts = base
    else:
        runs = _packed(F.col("text"), F.coalesce(F.when(F.col("start_line") != 0, F.col("start_line")), F.lit(1)), max_tokens)
        long = F.size(T.tokens(searchable(chunks))) > max_tokens
        parts = F.when(long & (F.size(runs) > 0), runs).otherwise(base)
    rows = chunks.select("*", F.posexplode(parts).alias("vector_ordinal", "__r"))
    own = F.col("__r.first").isNull()
    return rows.select(
        F.when(own, F.col("id")).otherwise(F.concat("id", F.lit(":v"), F.col("vector_ordinal").cast("string"))).alias("id"),
        *[c for c in chunks.columns if c not in ("id", "text", "start_line", "end_line")],
        F.col("__r.text").alias("text"),
        F.coalesce("__r.first", "start_line").alias("start_line"),
        F.coalesce("__r.last", "end_line").alias("end_line"),
        F.col("id").alias("parent_id"),
        "vector_ordinal",
    )
