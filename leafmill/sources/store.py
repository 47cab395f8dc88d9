"""Versioned tables of an engine's store.

A store is a folder on any file system that Spark reads. A commit writes the tables of a new version
beside those of older ones and then appends one row to ``commits``: readers go by the last commit, so
they never see half a version, and no table is overwritten while it is read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for tables that live as long as the application: under ``spark.checkpoint.dir``, or in
    a temporary folder of a local session that has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _scratch.setdefault(app, tempfile.mkdtemp(prefix="leafmill-"))
    return f"{shared.rstrip('/')}/leafmill/{app}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to a scratch table and read from it: for what is used more than once."""
    at = scratch(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self, schema: str) -> DataFrame | None:
        """All commits, or None where nothing has been committed."""
        try:
            return self.spark.read.schema(f"version long, {schema}".rstrip(", ")).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def version(self) -> int:
        """The last committed version, 0 where there is none."""
        found = self.commits("")
        return (found.agg(F.max("version")).first()[0] or 0) if found is not None else 0

    def write(self, table: str, version: int, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/{table}/v{version}"
        rows.write.mode("overwrite").parquet(at)  # what a writer that never committed has left behind goes
        return self.spark.read.schema(rows.schema).parquet(at)

    def commit(self, version: int, row: DataFrame) -> None:
        row.select(F.lit(version).cast("long").alias("version"), "*").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, the last one by default; None where it is missing."""
        version = self.version() if version is None else version
        try:
            return self.spark.read.parquet(f"{self.path}/{table}/v{version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def numbered(rows: DataFrame, order: list, start: int = 0) -> DataFrame:
    """rows with ``id``, which counts on from start in that order: a range sort, and the counts of the
    parts before. No task holds all rows; rows are evaluated twice."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a part
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    shift = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), (part + 1).cast("int"))
    return placed.withColumn("id", F.lit(start) + shift + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at")
