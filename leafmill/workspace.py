"""The engine's verbs over one page tree and its store."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, grep, index, read, search, verbosity, write
from .operators.chunks import chunk, locators
from .operators.embed import Embedder, create, hashing
from .operators.ledger_store import Ledger
from .sources.corpus import STORE, parse, scan
from .sources.store import Store


@dataclass(frozen=True)
class EmbeddingConfig:
    """Which embedder; unset fields take the backend's defaults."""

    backend: str = "hashing-ngram"
    dimensions: int | None = None

    @classmethod
    def from_env(cls, prefix: str = "LEAFMILL_EMBEDDING_") -> EmbeddingConfig:
        backend, size = (os.environ.get(prefix + k, "").strip() for k in ("BACKEND", "DIMENSIONS"))
        try:
            return cls(backend or cls.backend, int(size) if size else None)
        except ValueError:
            raise ValueError(f"{prefix}DIMENSIONS must be a whole number, not {size!r}") from None

    def embedder(self) -> Embedder:
        return create(self.backend, **({} if self.dimensions is None else {"dimensions": self.dimensions}))


class Workspace:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None) -> None:
        self.spark, self.root, self.embedder = spark, str(root).rstrip("/"), embedder or hashing()
        self.store = Store(spark, f"{self.root}/{STORE}/index")
        self.ledger = Ledger(Store(spark, f"{self.root}/{STORE}/ledger"))

    def files(self, include_raw: bool = False) -> DataFrame:
        return scan(self.spark, self.root, include_raw)

    def pages(self, include_raw: bool = False) -> DataFrame:
        return parse(self.files(include_raw))

    def reindex(self, include_raw: bool = False) -> DataFrame:
        """The ledger advances first; then all pages are indexed anew. Returns the status."""
        self.ledger.update(self.files(include_raw), time.time(), include_raw)
        index.build(self.store, self.pages(include_raw), self.embedder, include_raw, self.root)
        return self.status()

    def status(self) -> DataFrame:
        return index.status(self.store)

    def searcher(self) -> index.Searcher:
        if not self.store.version():
            self.reindex()
        return index.Searcher(self.store, self.embedder)

    def search(self, query: str, limit: int = 8, **filters) -> DataFrame:
        return self.searcher().search(query, limit, **filters)

    def search_explain(self, query: str, limit: int = 8, **filters) -> DataFrame:
        return self.searcher().explain(query, limit, **filters)

    def grep(self, pattern: str, include_raw: bool = False, **settings) -> DataFrame:
        return grep.grep(self.pages(include_raw), pattern, include_raw=include_raw, **settings)

    def read(self, path: str, heading: str | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
        """A page, the first chunk under a heading, or a range of lines."""
        page = self.pages(True).where(F.col("path") == write.safe_path(path).as_posix())
        if heading is not None:
            return read.by_heading(chunk(page), heading)
        if start_line is not None or end_line is not None:
            if start_line is None or end_line is None:
                raise ValueError("start_line and end_line go together")
            return read.line_range(page, start_line, end_line)
        return read.whole(page, path)

    def write(self, path: str, content: str, mode: str = "create", reindex: bool = True, heading: str | None = None, occurrence: int | None = None) -> dict:
        """Write a page; a reindex then keeps to what the index has of raw pages."""
        done = write.write_page(self.spark, self.root, path, content, mode, heading, occurrence)
        if reindex:
            self.reindex(bool(self.status().first()["include_raw"]))
        return done | {"reindexed": reindex}

    def is_verbose(self, path: str, compare_to: str | None = None, include_code: bool = False) -> DataFrame:
        pages = self.pages(True)
        page = pages.where(F.col("path") == path)
        if compare_to is None:
            return verbosity.judge(verbosity.metrics(page, include_code=include_code))
        pair = page.select("path", F.col("body").alias("source")).crossJoin(pages.where(F.col("path") == compare_to).select(F.col("body").alias("rewrite")))  # one row each
        compared = verbosity.compare(pair)
        measured = verbosity.metrics(page, include_code=include_code)
        return verbosity.judge(measured.join(compared.select("path", "compare_reasons"), "path"), extra_reasons="compare_reasons")

    def verbosity_audit(self, limit: int = 20, include_raw: bool = False, severity: str | None = None) -> DataFrame:
        return verbosity.audit(verbosity.judge(verbosity.metrics(self.pages(include_raw))), limit, severity)

    def change_summary(self, update: bool = False, include_raw: bool = False, **thresholds) -> tuple[DataFrame, DataFrame]:
        return self.ledger.summary(self.files(include_raw), time.time(), update, include_raw, **thresholds)

    def consistency_audit(self, include_raw: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """(one row: ok and the counters, the issues) of the index against the pages as they are."""
        version = self.store.version()
        raw = bool(self.status().first()["include_raw"]) if include_raw is None else include_raw
        pages = self.pages(raw)
        chunks = chunk(pages)
        counts = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
        now = pages.select("path", "size", "mtime").join(counts, "path", "left").na.fill(0, ["chunks"])
        manifest = self.status().select("pages_indexed", "chunks_indexed") if version else None
        files, rows, vectors = (self.store.read(t, version) if version else None for t in ("files", "chunks", "vectors"))
        expected = audit.rows_of(locators(rows, self.embedder.max_length)) if rows is not None else None
        found = audit.audit(now, chunks, manifest, files, rows, None if vectors is None else audit.rows_of(vectors), expected)
        return audit.summary(found, now, chunks, manifest, files, rows, vectors, expected), found
