"""Layered tables, and versioned tables that change together or not at all."""

from __future__ import annotations

import errno
import os
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT_SCHEMA = "seq bigint, version string, tables array<string>, committed_at timestamp"


def rename_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder its final name in one step; False, and nothing changed, when the name is taken.

    HDFS refuses a taken name inside the rename itself. A local rename does so for a folder that
    holds files. Object stores rename file by file, so they need one publisher at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = new.getFileSystem(conf)
    if system.getUri().getScheme() == "file":
        try:
            os.rename(*[unquote(urlparse(p).path) if p.startswith("file:") else p for p in (source, target)])
        except OSError as taken:
            if taken.errno in (errno.ENOTEMPTY, errno.EEXIST):
                return False
            raise
        return True
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(old, new, options)
    except Py4JJavaError as failure:
        if failure.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


class Layers:
    """Parquet tables in layers (bronze, silver, staging) that every run writes anew."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, layer: str, table: str) -> str:
        return os.path.join(self.root, layer, table)

    def replace(self, layer: str, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(layer, table))
        return self.read(layer, table)

    def append(self, layer: str, table: str, df: DataFrame) -> DataFrame:
        """Add rows by column name, whatever the case and order of the names.

        Columns that the rows lack are NULL in them, columns that the table lacks are NULL in its
        earlier rows. A column of another type is refused before anything is written.
        """
        current = self.read_or_none(layer, table, merge=True)
        if current is not None:
            known = {f.name.lower(): f for f in current.schema.fields}
            odd = [f"{f.name}: {f.dataType.simpleString()} for {known[f.name.lower()].dataType.simpleString()}" for f in df.schema.fields
                   if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType]
            if odd:
                raise ValueError(f"{layer}.{table}: {'; '.join(odd)}")
            df = df.select(*[F.col(f"`{c}`").alias(known[c.lower()].name if c.lower() in known else c) for c in df.columns])
        df.write.mode("append").parquet(self.path(layer, table))
        return self.read(layer, table, merge=True)

    def read(self, layer: str, table: str, merge: bool = False) -> DataFrame:
        """``merge``: the columns of all appends, which looks at every file's footer; else those of one of them."""
        return self.spark.read.option("mergeSchema", str(merge).lower()).parquet(self.path(layer, table))

    def read_or_none(self, layer: str, table: str, merge: bool = False) -> DataFrame | None:
        try:
            return self.read(layer, table, merge)
        except AnalysisException:
            return None


class PublishConflict(RuntimeError):
    """Another publisher took the same place in the commit list."""


class VersionedTables:
    """Write, audit, publish: tables are written beside the current ones and become current by one
    commit. A commit is one folder, written aside and renamed to its number in one step, so readers
    see all of it or nothing and of two publishers of a number one wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _data(self, version: str, table: str) -> str:
        return os.path.join(self.root, "versions", version, table)

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(self.root, "commits"))
        except AnalysisException:
            return self.spark.createDataFrame([], _COMMIT_SCHEMA)

    def write(self, version: str, table: str, df: DataFrame) -> DataFrame:
        """Write a table of a new version. A version is written once: never over data that may be current."""
        df.write.mode("errorifexists").parquet(self._data(version, table))
        return self.spark.read.parquet(self._data(version, table))

    def last_seq(self) -> int:
        return self._commits().agg(F.max("seq").alias("seq")).first()["seq"] or 0

    def publish(self, version: str, tables: list[str], seq: int | None = None) -> None:
        """Make a version current, as commit ``seq`` (the next one if not given). A taken number is refused."""
        seq = self.last_seq() + 1 if seq is None else seq
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(version).alias("version"),
            F.array(*[F.lit(t) for t in tables]).alias("tables"),
            F.current_timestamp().alias("committed_at"),
        )
        commits = os.path.join(self.root, "commits")
        aside = os.path.join(commits, f".aside-{uuid.uuid4().hex}")  # readers skip names with a dot
        row.write.mode("errorifexists").parquet(aside)
        if not rename_if_absent(self.spark, aside, os.path.join(commits, f"{seq:012d}")):
            raise PublishConflict(f"commit {seq} exists already; {version} was not published")

    def snapshot(self, tables: Sequence[str]) -> dict[str, DataFrame | None]:
        """The current version of all ``tables``, from one look at the commit list."""
        latest = self._commits().select("seq", "version", F.explode("tables").alias("table")).where(F.col("table").isin(list(tables)))
        found = {r["table"]: r["version"] for r in latest.groupBy("table").agg(F.max_by("version", "seq").alias("version")).collect()}
        return {t: self.spark.read.parquet(self._data(found[t], t)) if t in found else None for t in tables}

    def current_version(self, table: str) -> str | None:
        row = self._commits().where(F.array_contains("tables", table)).agg(
            F.max_by("version", "seq").alias("version")).first()
        return row["version"]

    def read(self, table: str) -> DataFrame | None:
        return self.snapshot([table])[table]
