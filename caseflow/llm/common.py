"""What several operators share: reading, stored intermediate tables, checked broadcasts, hashes and linked components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: At most this many narrow rows (ids, hashes) are sent to every task; above it the join is a shuffle.
BROADCAST_ROWS = 200_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: lineage is cut, a lost executor costs no rerun.

    The folder goes when the Python process ends.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fraction_below(key: Column, buckets: int) -> Column:
    """An even bucket, 0 to ``buckets`` - 1, from the first 52 bits of a hexadecimal digest."""
    return F.floor(F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * buckets).cast("long")


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: component is the smallest node that can be reached.

    Alternating large-star and small-star steps.  Nothing but edges moves, a star's hub is combined before its shuffle,
    each step is written to the shared folder, and the number of steps grows with the logarithm of the longest path.
    Edges with a null end and loops are no edges.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter((F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "edges")
    if now.isEmpty():
        return spark.createDataFrame([], "node bigint, component bigint")
    before = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        hooks = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(hooks, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(step.unionAll(hooks.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


PARTS = "part int, counts binary"
#: Numbers of one part of a counter array.
PART_SIZE = 1 << 14


def count_parts(counts: np.ndarray) -> pa.RecordBatch:
    """An array of counts as rows (part, counts), compressed, to be summed over tasks."""
    parts = [zlib.compress(counts[at:at + PART_SIZE].astype("<i8").tobytes(), 1) for at in range(0, len(counts), PART_SIZE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])


def summed_parts(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays of all tasks; parts are summed in parallel, and the result has the size of one array."""
    def unpacked(value: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(value), "<i8")

    def total(key: tuple, some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = sum(unpacked(x) for batch in some for x in batch.column("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([zlib.compress(summed.astype("<i8").tobytes(), 1)], pa.binary())], names=["part", "counts"])

    rows = parts.select("part", "counts").groupBy("part").applyInArrow(total, PARTS).collect()
    found = [unpacked(r["counts"]) for r in sorted(rows, key=lambda r: r["part"])]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def lowered_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 with A-Z lowered; the bytes methods know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at:at + size]
