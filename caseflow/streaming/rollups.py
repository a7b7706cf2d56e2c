"""Windowed statistics over a stream of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .monitor import query_id


def tag_counts(cases: DataFrame, window: str = "10 minutes", delay: str | None = None) -> DataFrame:
    """Cases per tag and event-time window; counts combine before the shuffle.

    No row is too late: the state has one number per window and tag.  ``delay`` lets Spark forget windows that are older
    by that much; rows that arrive for them afterwards are not counted.
    """
    timed = cases.withWatermark("ts", delay) if delay else cases
    return (timed.select("ts", F.explode("tags").alias("tag"))
            .groupBy(F.window("ts", window).alias("window"), "tag").count())


def write_updates(updates: DataFrame, path: str, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
    """Store changed windows per micro-batch; a repeated batch overwrites its own folder, and no query touches another's."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/query={query_id(batch)}/batch_id={batch_id}")

    return (updates.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of every window and tag, added up over the queries that count into ``path``."""
    return (spark.read.parquet(path).groupBy("query", "window", "tag")
            .agg(F.max_by("count", "batch_id").alias("count"))
            .groupBy("window", "tag").agg(F.sum("count").alias("count"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tag", "count"))
