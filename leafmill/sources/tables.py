"""Page, chunk and snapshot tables derived from plain document tables.

``as_pages`` gives a document table the shape of a page tree, ``as_markdown`` makes a Markdown page
of each conversation, ``as_snapshots`` and ``as_index`` are two states of the same pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = (("entities", "entity"), ("concepts", "concept"), ("comparisons", "comparison"), ("queries", "query"), ("raw", "raw"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def page_path() -> Column:
    return F.concat(_choice([f for f, _ in FOLDERS]), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def as_pages(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source) as single-chunk pages in five folders."""
    number = F.col("doc_id").cast("string")
    return documents.select(
        "doc_id", number.alias("id"), page_path().alias("path"), F.concat(F.lit("doc-"), number).alias("slug"),
        F.concat(F.lit("Document "), number).alias("title"), _choice([t for _, t in FOLDERS]).alias("type"),
        F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("confidence"),
        F.concat(F.lit("Document "), number).alias("heading"), F.lit(0).alias("level"), "text",
        (F.col("doc_id") % 5 == 4).alias("is_raw"), F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("end_line"),
        (F.col("doc_id") % 5).cast("int").alias("dir_rank"),
    )


def as_markdown(conversations: DataFrame) -> DataFrame:
    """One page per conversation: a title, and a section per turn."""
    turn = F.struct("turn", F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" ("), F.col("role"), F.lit(")\n\n"), F.col("text")).alias("md"))
    pages = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    number = F.col("conv_id").cast("string")
    body = F.concat(F.lit("# Conversation "), number, F.lit("\n\n"), F.array_join(F.transform("turns", lambda t: t["md"]), "\n\n"), F.lit("\n"))
    title = F.concat(F.lit("Conversation "), number)
    return pages.select(
        F.concat(F.lit("queries/conv-"), number, F.lit(".md")).alias("path"), F.concat(F.lit("conv-"), number).alias("slug"), title.alias("title"),
        F.lit("query").alias("type"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("confidence"),
        F.lit(0).alias("frontmatter_lines"), body.alias("body"), body.alias("text"), F.lit(False).alias("is_raw"), F.lit(3).alias("dir_rank"),
    )


def snapshot(pages: DataFrame) -> DataFrame:
    """(path, text) with the figures that the change ledger keeps."""
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    count = F.when(F.col("text") == "", F.lit(0)).otherwise(newlines + F.when(F.col("text").endswith("\n"), 0).otherwise(1))
    return pages.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), count.cast("long").alias("line_count"), "text")


def as_snapshots(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(previous, current): some pages gone, some new, some edited."""
    rows = documents.select("doc_id", page_path().alias("path"), "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return snapshot(rows.where("doc_id % 10 != 0")), snapshot(rows.where("doc_id % 11 != 0").withColumn("text", edited))


def as_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, indexed) chunk rows (id, path, size, chunks): the index lacks some, has some twice,
    some under another size, and some that no page has any more."""
    rows = documents.select("doc_id", page_path().alias("path"), F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size"))
    rows = rows.select("doc_id", F.substring(F.sha2(F.concat("path", "h"), 256), 1, 24).alias("id"), "path", "size", F.lit(1).cast("long").alias("chunks"))
    size = F.when(F.col("doc_id") % 19 == 0, F.col("size") + 1).otherwise(F.col("size"))
    indexed = rows.where("doc_id % 13 != 0").withColumn("size", size)
    indexed = indexed.withColumn("n", F.explode(F.when(F.col("doc_id") % 17 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n")
    return rows.where("doc_id % 23 != 0").drop("doc_id"), indexed.drop("doc_id")
