"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words, a SLOTS-th of all words (one word at least), so that the
schedule is as long and as exact for any input. Slot i falls on the golden-ratio point
frac(i * phi), which the cumulative targets map to a source; any stretch of the schedule keeps
close to the targets. A source's documents, shuffled by a hash and laid end to end, repeat as
often as it needs; its k-th slot takes the k-th block of that stream.

No step holds a source, or all sources, in one task: ranks of slots, places of documents and places of
sources are prefix sums in two levels (inside a chunk, and over the chunks' totals). The level that
the sources' shares rise to is found by sums over all sources, a few times over.

Defined cases: a null text has size 0 and nothing of it is taken; a null source is a source of its
own and comes last; repeated rows are separate documents; without any words all targets are 0; an
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, text_or_empty, word_count

PHI = 0.6180339887498949
#: A source repeats at most so often.
EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Slots of a mix, about.
SLOTS = 1 << 18
#: Documents that one window of the shuffled order holds, about; slots likewise.
CHUNK = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, place, source_size, target, total, lo, hi, whole): shares of all words by weight, where
    none exceeds epochs times its source's size. Sources that would exceed it are full, and the others
    share the rest by weight; as the level rises, more are full, until it stays. [lo, hi) of whole is
    the part of the schedule that belongs to a source."""
    spark = sizes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.repartitionByRange(n, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    ordered = cut(ordered.withColumn("ord", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id()).withColumn("one", F.lit(1)), "sources")
    placed = prefix(ordered, "one", "chunk", F.lit(1).cast("long"), ["ord"]).withColumn("place", F.col("before") + 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = cut(placed.select("source", "source_size", "place", w.alias("w"), "chunk", "one"), "placed-sources")
    cap = epochs * F.col("source_size")
    total, level = s.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        full = cap / F.col("w") < level
        done, left = s.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w")))).first()
        higher = (total - (done or 0)) / left if left else level
        if higher <= level:
            break
        level = higher
    target = F.least(cap.cast("double"), F.lit(max(level, 0.0)) * F.col("w"))
    s = s.withColumn("target", target)
    whole = s.agg(F.sum("target")).first()[0] or 0.0
    found = prefix(s, "one", "chunk", F.col("target"), ["place"]).withColumn("lo", F.col("before").cast("double"))
    return found.select("source", "place", "source_size", "target", F.lit(total).alias("total"), "lo", (F.col("lo") + F.col("target")).alias("hi"), F.lit(whole).alias("whole"))


def prefix(rows: DataFrame, key: str, chunk: str, value, order: list) -> DataFrame:
    """rows with ``before``: the sum of value over the earlier rows of the same key, where chunks
    follow each other and ``order`` holds inside a chunk."""
    totals = rows.groupBy(key, chunk).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(key).alias("__k"), F.col(chunk).alias("__c"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(starts, (F.col(key) == F.col("__k")) & (F.col(chunk) == F.col("__c")))
    return joined.withColumn("before", F.col("__local") + F.col("__start")).drop("__local", "__start", "__k", "__c")


def schedule(sources: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(place, rank): for every slot its source and which of that source's slots it is, from 0."""
    spark = sources.sparkSession
    cells = 4 * n_sources
    lo, hi = F.col("lo") / F.col("whole"), F.col("hi") / F.col("whole")
    # equi-join on a cell of the unit interval; a cell holds a few sources at most on average
    guide = sources.where("target > 0").select("place", lo.alias("lo"), F.when(F.col("hi") >= F.col("whole") * (1 - 1e-12), F.lit(2.0)).otherwise(hi).alias("hi"))
    guide = guide.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    u = F.col("id") * F.lit(PHI) - F.floor(F.col("id") * F.lit(PHI))
    points = spark.range(slots).select("id", u.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    hit = points.join(small_side(guide, 40, 6 * n_sources), "cell").where("u >= lo AND u < hi")
    hit = hit.select("id", "place", F.floor(F.col("id") / CHUNK).alias("chunk"))
    return prefix(hit, "place", "chunk", F.lit(1).cast("long"), ["id"]).select("place", F.col("before").alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sizes = cut(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), key.alias("key")), "sizes")
    sources = cut(targets(sizes, weights, epochs), "targets")
    stats = sources.agg(F.count(F.lit(1)), F.max("total"), F.max("place")).first()
    n_sources, total = stats[0], stats[1] or 0
    out = ["doc_id", "source", "size", "source_size", "target"]
    known = sizes.join(small_side(sources.select(F.col("source").alias("__s"), "place", "source_size", "target"), 80, n_sources), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    if not total:
        return known.select(*out, F.lit(0).cast("long").alias("taken"))
    step = max(1, total // slots)
    count = -(-total // step)
    wanted = schedule(sources, count, n_sources)
    digits = max(1, min(7, (max(1, sizes.count() // CHUNK)).bit_length() // 4 + 2))
    placed = prefix(known.where("size > 0").withColumn("chunk", F.substring("key", 1, digits)), "place", "chunk", F.col("size"), ["key", "doc_id", "size"])
    # where the document's words lie in each pass over the source, by block
    passes = F.sequence(F.lit(0), F.lit(epochs - 1))
    starts = placed.select(*out, "place", "before", F.explode(passes).alias("pass")).withColumn("at", F.col("before") + F.col("pass") * F.col("source_size"))
    first, last = F.floor(F.col("at") / step), F.floor((F.col("at") + F.col("size") - 1) / step)
    parts = starts.withColumn("rank", F.explode(F.sequence(first, last)))
    held = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * step) - F.greatest(F.col("at"), F.col("rank") * step)
    taken = parts.select(*out, "place", "before", "rank", held.alias("held")).join(wanted.withColumn("__hit", F.lit(1)), ["place", "rank"], "left")
    taken = taken.groupBy("place", "before").agg(*[F.first(c).alias(c) for c in out], F.coalesce(F.sum(F.col("held") * F.col("__hit")), F.lit(0)).cast("long").alias("taken"))
    none = known.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return taken.select(*out, "taken").unionByName(none)


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix takes them: a document stands as often as the words taken from it, to the
    nearest whole number of copies; one without words stands once."""
    taken = mix(docs, **settings).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")))
    taken = cut(taken.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), copies.cast("int").alias("__copies")).where("__copies > 0"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (word_count(text_or_empty()) == F.col("__n"))
    joined = docs.join(small_side(taken, 64), same)
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
