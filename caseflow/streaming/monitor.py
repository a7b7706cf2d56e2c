"""Continuous ingestion: new text is validated, de-duplicated, parsed, redacted and appended."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules as R
from ..functions import fields as X
from ..operators.parse import ingest
from ..sources import commits
from ..sources.vault import write_ingested
from .stateful import earliest_within, rocksdb

log = logging.getLogger(__name__)

#: Parts of the rows within which copies are dropped first.
PARTS = 64


@dataclass(frozen=True)
class Target:
    """Where a monitor writes and the vault key it uses.  ``late`` holds raw rows: give it the protection of the source."""

    store: str
    vault: str
    keys: DataFrame
    key_id: str
    late: str | None = None


def valid_content(stream: DataFrame, min_length: int = R.MIN_CONTENT_LENGTH) -> DataFrame:
    return stream.filter(X.is_case_content(F.col("content"), min_length))


def dedupe_seen(stream: DataFrame, parts: int = PARTS) -> DataFrame:
    """Drop a text that the stream has held before, however late it comes.

    The hashes are in Spark's state store, so a batch costs what it holds, whatever was seen earlier.  Copies are first
    dropped within ``parts`` parts of the rows and then among what is left, so the copies of one text never meet in one task.
    """
    hashed = stream.withColumn("content_md5", F.md5("content")).withColumn("_part", F.pmod(F.xxhash64("ingest_seq"), F.lit(parts)))
    return hashed.dropDuplicates(["content_md5", "_part"]).dropDuplicates(["content_md5"]).drop("_part")


def query_id(batch: DataFrame) -> str | None:
    """The id of the streaming query that hands over ``batch``: its checkpoint keeps it, no other query has it."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def not_stored(batch: DataFrame, store: str, writer: str) -> DataFrame:
    """The rows of ``batch`` that no other writer has stored: same number, same text.

    They are there where a checkpoint was lost and a new query reads its source again.  Only two narrow columns are read, and
    only of batches whose range of numbers meets this one's.
    """
    spark = batch.sparkSession
    others = [c for c in commits.committed(spark, store) if not c.batch.startswith(f"{writer}-")]
    if others:
        numbers = commits.numbers_of(batch)
        others = [c for c in others if c.may_hold(numbers)]
    if not others:
        return batch
    held = commits.read_batches(spark, store, "ingest_seq bigint, content_md5 string", others).distinct()
    held = held.select(F.col("ingest_seq").alias("_number"), F.col("content_md5").alias("_md5"))
    return batch.join(held, F.col("ingest_seq").eqNullSafe(F.col("_number")) & F.col("content_md5").eqNullSafe(F.col("_md5")), "left_anti")


def write_batch(batch: DataFrame, batch_id: int, target: Target, writer: str | None = None, **options) -> None:
    """Add one micro-batch under the name of its writer and its number.

    Running it again replaces what it has written.  Batches of other writers are never touched, and rows that they have
    stored are not stored again.
    """
    name = f"{writer}-{batch_id}" if writer else str(batch_id)
    if writer:
        batch = not_stored(batch, target.store, writer)
    suggested = X.detected_case_id(F.col("content"), R.DETECT_ID_RULES)  # the first of ``detect_case_ids``, without the others
    named = batch.withColumn("given_case_id", F.coalesce("given_case_id", suggested))
    write_ingested(ingest(named, **options), target.store, target.vault, target.keys, target.key_id, name)


def _step(batch: DataFrame, batch_id: int, target: Target, **options) -> None:
    """One micro-batch of a running query: late rows beside the store, the others into it.  What is committed is left."""
    writer = query_id(batch)
    if any(c.batch == f"{writer}-{batch_id}" for c in commits.committed(batch.sparkSession, target.store)):
        return
    batch.persist()  # what the state gives out is computed once
    try:
        if batch.isEmpty():
            return
        fresh = batch
        if "late" in batch.columns:
            fresh = batch.filter("NOT late").drop("late")
            if target.late:
                commits.write_batch(batch.filter("late").drop("late"), target.late, f"{writer}-{batch_id}")
        write_batch(fresh, batch_id, target, writer, **options)
    finally:
        batch.unpersist()


def monitor(stream: DataFrame, target: Target, checkpoint: str, interval: str | None = "1 second",
            min_length: int = R.MIN_CONTENT_LENGTH, delay: str | None = None, **options) -> StreamingQuery:
    """Start ingesting ``stream`` (source, ingest_seq, ts, given_case_id, content): valid texts, each once.

    ``interval=None`` processes what is there and stops.  A failed batch stops the query and is repeated when it is
    started again with its checkpoint.  Any number of monitors may share a store; one that starts without its old checkpoint
    stores nothing twice, unless it runs beside the query that it repeats.

    With ``delay`` texts are remembered for so long only (``stateful.earliest_within``): the state is bounded, the earliest
    copy of a text in a batch is the one that is stored, and rows that come later than that go to ``target.late`` as they
    are.  Without it every text is remembered.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    valid = valid_content(stream, min_length)
    # Texts are forgotten with the next rows: no batches without any are run for it.
    with rocksdb(stream.sparkSession, noDataMicroBatches="false"):
        return ((earliest_within(valid, delay) if delay else dedupe_seen(valid)).writeStream
                .foreachBatch(lambda batch, n: _step(batch, n, target, **options))
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def keep_running(start: Callable[[], StreamingQuery], interval: float = 1.0, max_restarts: int | None = None) -> int:
    """Run a query until it ends by itself; after a failure wait twice the interval and start it again.

    The checkpoint makes the new run repeat the failed batch.  Returns the number of restarts.
    """
    restarts = 0
    while True:
        try:
            start().awaitTermination()
            return restarts
        except StreamingQueryException as error:
            if max_restarts is not None and restarts >= max_restarts:
                raise
            restarts += 1
            log.warning("monitor failed, restart %d: %s", restarts, error)
            time.sleep(2 * interval)
