"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each partition hashes its texts, keeps the distinct hashes sorted, splits them by owner (a
   range of hash values) and sends each owner its slice, Golomb-coded.
2. An owner marks the hashes that more than one partition sent and returns one bit for each.
3. At home the bit, or a repeat inside the partition, makes a hash suspect. Only the rows with
   suspect hashes are shuffled with their text, which is grouped by its bytes: a text's group is
   found by equality and never by its hash alone.

Rows whose hash nobody else has never leave their partition. A group's verdict is a few numbers
under its hash and SHA-256; rows find it by these, and no text is shuffled for it unless the
caller asks for the texts of all rows that stay and the verdicts are too many for a broadcast.

Defined cases: a null text counts as empty, and empty texts equal each other; very long texts are
compared whole, like any other; a null doc_id is smaller than any other; of rows with the same text
and the same largest doc_id exactly one is kept; an empty table gives an empty table; other columns
pass through unread, whatever their names, but ``annotate`` replaces those that it returns itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import cut, small_side, text_or_empty

#: Hashes that one owner sorts at most, about; 8 bytes each.
OWNER_HASHES = 4_000_000
_H, _SHA = "__h", "__sha"

Fingerprint = Callable[[Column], Column]


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.asarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64) for b in batches if b.num_rows]
        block = TaskContext.get().partitionId()
        if not got:
            return
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        rows = [
            (block, int(o[0]), golomb.encode(v, int(v[0])), golomb.bitmap(c > 1))
            for v, o, c in zip(np.split(values, cuts), np.split(owner, cuts), np.split(counts, cuts))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "owner", "blob", "repeats"])

    return run


def _own(table: pa.Table) -> pa.Table:
    """All slices of one owner: a bitmap for each, set where another slice has the hash too."""
    slices = [golomb.decode(b.as_py()) for b in table.column("blob")]
    values, counts = np.unique(np.concatenate(slices), return_counts=True)
    shared = values[counts > 1]
    marks = [golomb.bitmap(np.isin(s, shared)) for s in slices]
    return pa.table({"block": table.column("block"), "owner": table.column("owner"), "shared": pa.array(marks, pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for blob, repeats, shared in zip(*(b.column(c).to_pylist() for c in ("blob", "repeats", "shared"))):
            v = golomb.decode(blob)
            found.append(v[golomb.unbitmap(repeats, len(v)) | golomb.unbitmap(shared, len(v))])
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=[_H])


def suspect_hashes(hashes: DataFrame, rows: int) -> DataFrame:
    """The hashes of ``hashes`` (one long column) that two rows or more have."""
    spark = hashes.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // OWNER_HASHES))
    blocks = cut(hashes.mapInArrow(_send(owners), "block long, owner long, blob binary, repeats binary"), "fingerprints")
    shared = blocks.select("block", "owner", "blob").groupBy("owner").applyInArrow(_own, "block long, owner long, shared binary")
    home = blocks.join(shared, ["block", "owner"])
    return home.select("blob", "repeats", "shared").mapInArrow(_suspects, f"{_H} long").distinct()


def duplicate_groups(docs: DataFrame, fingerprint: Fingerprint = F.xxhash64) -> DataFrame:
    """One row per text that two rows or more have: its hash and SHA-256, keep_id, group_size and
    ``ties``, the number of rows that have keep_id."""
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn(_H, fingerprint(F.col("text")))
    suspects = cut(suspect_hashes(keyed.select(_H), docs.count()), "suspect-hashes")
    rows = cut(keyed.join(small_side(suspects, 16), _H, "left_semi").withColumn(_SHA, F.unhex(F.sha2("text", 256))), "suspects")
    # Grouping by the text compares bytes; repeats inside a partition collapse before the shuffle.
    groups = rows.groupBy(_H, _SHA, "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(_H, _SHA, "keep_id", "group_size")
    holders = rows.groupBy(_H, _SHA, "doc_id").agg(F.count(F.lit(1)).alias("ties")).where("ties > 1")
    holders = holders.select(F.col(_H).alias("__h2"), F.col(_SHA).alias("__sha2"), "doc_id", "ties")
    same = (F.col(_H) == F.col("__h2")) & (F.col(_SHA) == F.col("__sha2")) & F.col("keep_id").eqNullSafe(F.col("doc_id"))
    return cut(groups.join(holders, same, "left").select(_H, _SHA, "keep_id", "group_size", F.coalesce("ties", F.lit(1)).alias("ties")), "verdicts")


def _judged(docs: DataFrame, fingerprint: Fingerprint) -> DataFrame:
    """The caller's columns as __c0, __c1, ... and the verdict as __keep, __size, __kept, __sha."""
    groups = duplicate_groups(docs, fingerprint)
    text = text_or_empty()
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*own, F.col("doc_id").alias("__id"), fingerprint(text).alias(_H), F.unhex(F.sha2(text, 256)).alias(_SHA))
    g = groups.select(F.col(_H).alias("__gh"), F.col(_SHA).alias("__gsha"), F.col("keep_id").alias("__top"), F.col("group_size").alias("__n"), F.col("ties").alias("__ties"))
    joined = keyed.join(small_side(g, 120), (F.col(_H) == F.col("__gh")) & (F.col(_SHA) == F.col("__gsha")), "left")
    alone = F.col("__n").isNull()
    out = joined.select(
        *[f"__c{i}" for i in range(len(own))],
        F.when(alone, F.col("__id")).otherwise(F.col("__top")).alias("__keep"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("__size"),
        (alone | F.col("__id").eqNullSafe(F.col("__top"))).alias("__kept"),
        _SHA,
        F.coalesce("__ties", F.lit(1)).alias("__ties"),
    )
    if groups.where("ties > 1").isEmpty():
        return out
    tied = F.col("__kept") & (F.col("__ties") > 1)
    again = cut(out.where(tied).withColumn("__row", F.monotonically_increasing_id()), "ties")
    first = again.groupBy(F.col(_SHA).alias("__s")).agg(F.min("__row").alias("__first"))
    again = again.join(first, F.col(_SHA) == F.col("__s")).withColumn("__kept", F.col("__row") == F.col("__first"))
    return out.where(~tied).unionByName(again.select(*out.columns))


def annotate(docs: DataFrame, fingerprint: Fingerprint = F.xxhash64) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 for every row."""
    new = {"keep_id": F.col("__keep"), "group_size": F.col("__size"), "kept": F.col("__kept"), "text_sha256": F.lower(F.hex(_SHA))}
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new]
    return _judged(docs, fingerprint).select(*own, *[c.alias(k) for k, c in new.items()])


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact deduplication drops."""
    kept = _judged(docs, F.xxhash64).where("__kept")
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
