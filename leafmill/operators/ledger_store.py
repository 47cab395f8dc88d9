"""The change ledger kept in a store: the last snapshot, and all events so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FILE_CHANGES, FILE_STATE
from ..sources.store import Store, numbered
from ..sources.tables import snapshot
from . import ledger as L

_COMMIT = "observed_at double, events long, last_id long"


class Ledger:
    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark

    def state(self) -> DataFrame:
        """FILE_STATE of the last update; empty before the first."""
        found = self.store.read("state") if self.store.version() else None
        return found if found is not None else self.spark.createDataFrame([], FILE_STATE)

    def log(self) -> DataFrame:
        """All events (FILE_CHANGES) of committed updates."""
        commits = self.store.commits(_COMMIT)
        empty = self.spark.createDataFrame([], FILE_CHANGES)
        if commits is None:
            return empty
        paths = [f"{self.store.path}/changes/v{r.version}" for r in commits.select("version").distinct().collect()]  # one row an update
        return self.spark.read.schema(empty.schema).parquet(*paths)

    def pending(self, pages: DataFrame) -> DataFrame:
        """Events between the last update and pages (path, text), with line counts of what changed."""
        return L.with_line_diff(L.diff(self.state().withColumnRenamed("content_text", "text"), snapshot(pages)))

    def update(self, pages: DataFrame, observed_at: float, include_raw: bool = False) -> int:
        """Append the pending events and replace the state, in one commit; returns the number of events."""
        last = self.store.commits(_COMMIT)
        start = (last.agg(F.max("last_id")).first()[0] or 0) if last is not None else 0
        version = self.store.version() + 1
        found = self.store.write("pending", version, self.pending(pages))
        # changed pages first, then deleted ones
        events = numbered(found, [F.col("kind") == "deleted", F.col("path")], start).withColumn("observed_at", F.lit(float(observed_at)))
        names = [x.strip().split(" ")[0] for x in FILE_CHANGES.split(",")]
        written = self.store.write("changes", version, events.select(*names))
        n = written.count()
        if not n:
            return 0
        kept = snapshot(pages).withColumnRenamed("text", "content_text").withColumn("last_seen_at", F.lit(float(observed_at))).withColumn("include_raw", F.lit(int(include_raw)))
        self.store.write("state", version, kept)
        self.store.commit(version, self.spark.createDataFrame([(float(observed_at), n, start + n)], _COMMIT))
        return n

    def summary(self, pages: DataFrame, observed_at: float, update: bool = False, include_raw: bool = False, changes: int = 1, size: int = 1, lines: int = 1) -> tuple[DataFrame, DataFrame]:
        """(one row of counts, deltas and the gate; one row per path in order). What is pending counts
        before an update; after it the paths show it as recorded."""
        events = self.store.write("seen", self.store.version() + 1, self.pending(pages))
        if update:
            self.update(pages, observed_at, include_raw)
        log = self.log()
        head = L.gate(L.aggregate(events), changes, size, lines).crossJoin(log.agg(F.count(F.lit(1)).alias("total_events")))  # one row each
        rows = L.rollup(self.state(), log, events.limit(0) if update else events, None if update else snapshot(pages))
        return head, L.in_order(rows)
