"""Batches of one table by any number of writers: a batch is in the table once its commit is there.

A writer puts its rows into a folder that only it knows (``batch_id=<name>/attempt=<random>``) and then creates one empty
file below ``_commits``, whose name tells batch, version, attempt and the range of row numbers.  Creating a file is a single
step on every file system, so readers, who follow the commits alone, see a batch whole or not at all; folders of writers that
failed or were overtaken are never read.  Writing a batch again under its name adds the next version, which replaces the
rows; different names never touch each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_commits"
#: The range of a batch without rows, and of one whose rows have no number.
NO_ROWS, ANY_NUMBER = "none", "any"


@dataclass(frozen=True)
class Commit:
    batch: str
    version: int
    attempt: str
    numbers: str

    @property
    def name(self) -> str:
        return "@".join([quote(self.batch, safe=""), f"{self.version:06d}", self.attempt, self.numbers])

    @property
    def folder(self) -> str:
        return f"batch_id={quote(self.batch, safe='')}/attempt={self.attempt}"

    def may_hold(self, numbers: str) -> bool:
        """Whether a row number of the other range can be in this batch."""
        if NO_ROWS in (self.numbers, numbers):
            return False
        if ANY_NUMBER in (self.numbers, numbers):
            return True
        (low, high), (other_low, other_high) = (map(int, x.split("..")) for x in (self.numbers, numbers))
        return low <= other_high and other_low <= high


def _file(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[Commit]:
    """The batches of a table, each with its last version.  One name per batch reaches the driver, never a row."""
    folder, files = _file(spark, f"{path}/{FOLDER}")
    newest: dict[str, Commit] = {}
    for status in files.listStatus(folder) if files.exists(folder) else ():
        batch, version, attempt, numbers = status.getPath().getName().split("@")
        found = Commit(unquote(batch), int(version), attempt, numbers)
        kept = newest.setdefault(found.batch, found)
        # Two writers of one batch may have met: all readers agree on one of them.
        if (kept.version, kept.attempt) < (found.version, found.attempt):
            newest[found.batch] = found
    return sorted(newest.values(), key=lambda c: c.batch)


def numbers_of(rows: DataFrame, order: str = "ingest_seq") -> str:
    """The range of row numbers, as commits hold it."""
    found = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"), F.count(order).alias("numbered")).first()
    if not found["n"]:
        return NO_ROWS
    return f"{found['low']}..{found['high']}" if found["numbered"] == found["n"] else ANY_NUMBER


def write_batch(rows: DataFrame, path: str, batch: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Add ``rows`` as one batch, a new one without a name.  A batch of that name is replaced when this one is complete."""
    spark = rows.sparkSession
    batch = batch or uuid.uuid4().hex
    before = next((c for c in committed(spark, path) if c.batch == batch), None)
    new = Commit(batch, before.version + 1 if before else 0, f"w{uuid.uuid4().hex}", "")
    folder = f"{path}/{new.folder}"
    rows.write.partitionBy(*partition_by).parquet(folder)
    numbers = numbers_of(spark.read.schema("ingest_seq bigint").parquet(folder)) if "ingest_seq" in rows.columns else ANY_NUMBER
    new = Commit(new.batch, new.version, new.attempt, numbers)
    place, files = _file(spark, f"{path}/{FOLDER}/{new.name}")
    files.create(place, False).close()
    if before:  # nobody reads the old version from now on
        for name in (f"{path}/{FOLDER}/{before.name}", f"{path}/{before.folder}"):
            place, files = _file(spark, name)
            files.delete(place, True)


def read_batches(spark: SparkSession, path: str, schema: str, batches: Sequence[Commit] | None = None) -> DataFrame:
    """The rows of all committed batches, or of those given, with exactly the columns of ``schema``."""
    batches = committed(spark, path) if batches is None else batches
    if not batches:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{c.folder}" for c in batches])
    return read.select(*spark.createDataFrame([], schema).columns)
