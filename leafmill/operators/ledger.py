"""The change ledger: snapshots compared, events counted, and a gate for significant change."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Events of pages that were added, modified or deleted between two snapshots. A missing side
    counts no bytes and no lines. One full outer join on the path; texts come along only where a
    page has changed."""
    old = previous.select("path", *[F.col(c).alias(f"old_{c}") for c in ("sha256", "size_bytes", "line_count", "text")])
    new = current.select("path", *[F.col(c).alias(f"new_{c}") for c in ("sha256", "size_bytes", "line_count", "text")])
    both = old.join(new, "path", "full_outer").where(~F.col("old_sha256").eqNullSafe(F.col("new_sha256")))
    kind = F.when(F.col("old_sha256").isNull(), "added").when(F.col("new_sha256").isNull(), "deleted").otherwise("modified")
    zero = F.lit(0).cast("long")
    sizes = [F.coalesce(c, zero).alias(c) for c in ("old_size_bytes", "new_size_bytes", "old_line_count", "new_line_count")]
    rows = both.select("path", kind.alias("kind"), "old_sha256", "new_sha256", *sizes, "old_text", "new_text")
    return rows.withColumn("byte_delta", F.col("new_size_bytes") - F.col("old_size_bytes")).withColumn("line_delta", F.col("new_line_count") - F.col("old_line_count"))


def _count(old: str, new: str) -> tuple[int, int]:
    added = removed = 0
    for tag, a, b, c, d in SequenceMatcher(a=old.splitlines(), b=new.splitlines()).get_opcodes():
        if tag != "equal":
            removed += b - a
            added += d - c
    return added, removed


def with_line_diff(events: DataFrame) -> DataFrame:
    """events with added_lines and removed_lines instead of the texts. Only modified pages need the
    matcher, in Python; what was added or deleted counts all its lines."""
    keep = [c for c in events.columns if c not in ("old_text", "new_text")]
    plain = events.where("kind != 'modified'").select(*keep, F.col("new_line_count").alias("added_lines"), F.col("old_line_count").alias("removed_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [_count(o or "", n or "") for o, n in zip(b.column("old_text").to_pylist(), b.column("new_text").to_pylist())]
            columns = [b.column(c) for c in keep] + [pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "added_lines", "removed_lines"])

    changed = events.where("kind = 'modified'")
    return plain.unionByName(changed.mapInArrow(run, plain.schema))


def aggregate(events: DataFrame) -> DataFrame:
    """One row: events by kind, and sums of the deltas, plain and absolute."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")]
    lines = [total(c).alias(c) for c in ("added_lines", "removed_lines") if c in events.columns]
    return events.agg(
        F.count(F.lit(1)).alias("pending_events"), *kinds, total("byte_delta").alias("byte_delta"), total("line_delta").alias("line_delta"),
        total(F.abs("byte_delta")).alias("abs_byte_delta"), total(F.abs("line_delta")).alias("abs_line_delta"), *lines,
    )


def gate(summed: DataFrame, changes: int = 1, size: int = 1, lines: int = 1) -> DataFrame:
    """summed with significant_change: something is pending, and one of the counts is reached."""
    hit = (F.col("pending_events") >= max(changes, 0)) | (F.col("abs_byte_delta") >= max(size, 0)) | (F.col("abs_line_delta") >= max(lines, 0))
    return summed.withColumn("significant_change", (F.col("pending_events") > 0) & hit)


def rollup(state: DataFrame, log: DataFrame, pending: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row per path of the state, the pending events and, for a dry run, the current pages: how
    often it changed, how last, and its size. The log is read once, not once a path."""
    diff_of = F.struct("byte_delta", "line_delta", F.abs("byte_delta").alias("abs_byte_delta"), F.abs("line_delta").alias("abs_line_delta"), *[c for c in ("added_lines", "removed_lines") if c in pending.columns])
    past = log.groupBy("path").agg(F.count(F.lit(1)).alias("past"), F.max_by(F.struct(F.col("kind").alias("kind"), diff_of.alias("diff")), "id").alias("last"))
    now = pending.select("path", F.col("kind").alias("now_kind"), diff_of.alias("now_diff"), F.col("new_size_bytes").alias("now_size"), F.col("new_line_count").alias("now_lines"))
    paths = state.select("path").unionByName(pending.select("path"))
    if current is not None:
        paths = paths.unionByName(current.select("path"))
    rows = paths.distinct().join(now, "path", "left").join(past, "path", "left").join(state.select("path", "size_bytes", "line_count"), "path", "left")
    is_now = F.col("now_kind").isNotNull()
    either = lambda a, b: F.when(is_now, F.col(a)).otherwise(F.col(b))
    return rows.select(
        "path", (F.coalesce("past", F.lit(0)) + is_now.cast("int")).alias("change_count"), either("now_kind", "last.kind").alias("last_change_kind"),
        either("now_size", "size_bytes").alias("size_bytes"), either("now_lines", "line_count").alias("line_count"), is_now.alias("pending"), either("now_diff", "last.diff").alias("last_diff"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    gap: Column = F.coalesce("last_diff.abs_byte_delta", F.lit(0))
    return rows.orderBy(F.desc("pending"), F.desc("change_count"), gap.desc(), "path")
