"""What a stream remembers, in the engine's own state store: seen texts, the newest texts of a source, its last text.

State is keyed and versioned by the engine, kept in RocksDB beside the executors and saved with the checkpoint; nothing here
reads or writes folders of its own.  Each operator forgets by event time, so its state is bounded by the delay and the rate of
the stream, not by how long it runs.  A row older than the delay allows is not lost: it comes out marked ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: When more than MOST texts of a source are remembered, the newest KEPT stay.
MOST, KEPT = 1000, 500
#: Keys that sources are dealt to: a call into Python, and the state that it reads, is for one of them.
BUCKETS = 1024
#: Slices that the time which rows of ``changes`` may wait is cut into, and clean-ups of silent sources in their time.
SLICES, CLEANED = 8, 8

ROW_SCHEMA = "source string, ingest_seq bigint, ts timestamp, content_hash string, late boolean"


@contextmanager
def rocksdb(spark: SparkSession, **more: str) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back afterwards."""
    settings = {PROVIDER: ROCKSDB} | {f"spark.sql.streaming.{k}.enabled": v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _remembered(rows: DataFrame, keys: list[str], processor: StatefulProcessor, timed: bool = True) -> DataFrame:
    """``rows`` through a processor that returns rows of the same columns and ``late``."""
    schema = StructType([*rows.schema.fields]).add("late", BooleanType())
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "eventTime" if timed else "none").drop("_ms")


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """``stream`` with a watermark, and its time as milliseconds in ``_ms``.

    The engine drops late rows before an operator that sees the marked column.  The numbers are not marked: late rows reach
    the processors, which hand them on.
    """
    plain = F.timestamp_micros(F.unix_micros("ts")).alias("ts")
    marked = stream.withWatermark("ts", delay)
    return marked.select(*[plain if c == "ts" else F.col(c) for c in stream.columns], F.unix_millis("ts").alias("_ms"))


def _out(row: Row, late: bool) -> Row:
    return Row(**row.asDict(), late=late)


def _number(row: Row) -> tuple[bool, int]:
    return row.ingest_seq is not None, row.ingest_seq or 0


class _Seen(StatefulProcessor):
    """Of the rows of a text the first one, once."""

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, first, newest = timerValues.getCurrentWatermarkInMs(), None, -1
        for row in rows:
            if row._ms is not None and row._ms < now:
                yield _out(row, True)
                continue
            newest = max(newest, row._ms if row._ms is not None else now)
            if first is None or _number(row) < _number(first):
                first = row
        if first is None:
            return
        known = self.until.get()
        if known is None:
            yield _out(first, False)
        until = newest + self.delay_ms + 1
        if known is None or until > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(until)
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def _milliseconds(delay: str) -> int:
    number, unit = delay.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")] * 1000


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies of a text in one batch of rows the one with the least number and the latest one."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        chosen = set()
        for column, direction in (("ingest_seq", "ascending"), ("_ms", "descending")):
            order = pc.sort_indices(table, sort_keys=[("content_md5", "ascending"), (column, direction)], null_placement="at_end")
            md5 = table["content_md5"].take(order).to_pylist()
            chosen.update(k for k, this, before in zip(order.to_pylist(), md5, [object(), *md5]) if this != before)
        yield from table.take(pa.array(sorted(chosen), pa.int64())).combine_chunks().to_batches()


def earliest_within(stream: DataFrame, delay: str) -> DataFrame:
    """Drop a text that the stream has held within ``delay`` before; of the copies in a batch the one with the least
    ``ingest_seq`` stays.  Adds ``content_md5`` and ``late``.

    A text is forgotten when the watermark has passed its latest copy by ``delay``, so the state holds the distinct texts of
    that time and no more.  Rows older than the watermark are handed on with ``late``; of a text whose first copies are late,
    another one that is not stands for it.  Rows without a time count as new.  Copies are reduced where they are read: a
    text that makes up a third of the rows sends two rows per Arrow batch to its task.
    """
    hashed = _timed(stream.withColumn("content_md5", F.md5("content")), delay)
    fewer = hashed.mapInArrow(_fewer, hashed.schema)
    return _remembered(fewer, ["content_md5"], _Seen(_milliseconds(delay)))


def _bucket(*keys: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _numbers() -> list[Column]:
    """``ingest_seq`` and ``ts`` as numbers that are never NULL and a flag each: in pandas, NULLs would make them floating ones."""
    us, zero = F.unix_micros("ts"), F.lit(0).cast("bigint")
    return [F.coalesce("ingest_seq", zero).alias("number"), F.col("ingest_seq").isNotNull().alias("numbered"),
            F.coalesce(us, zero).alias("us"), us.isNotNull().alias("timed")]


def _back() -> dict[str, Column]:
    return {"ingest_seq": F.when(F.col("numbered"), F.col("number")), "ts": F.when(F.col("timed"), F.timestamp_micros("us"))}


def _bucket(*keys: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _numbers() -> list[Column]:
    """``ingest_seq`` and ``ts`` as numbers that are never NULL and a flag each: in pandas, NULLs would make them floating ones."""
    us, zero = F.unix_micros("ts"), F.lit(0).cast("bigint")
    return [F.coalesce("ingest_seq", zero).alias("number"), F.col("ingest_seq").isNotNull().alias("numbered"),
            F.coalesce(us, zero).alias("us"), us.isNotNull().alias("timed")]


def _back() -> dict[str, Column]:
    return {"ingest_seq": F.when(F.col("numbered"), F.col("number")), "ts": F.when(F.col("timed"), F.timestamp_micros("us"))}


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(rows)).read_all()


#: How columns that are no texts are written as JSON, to come back as they were.
JSON_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
MEMORY_ARROW = pa.schema([("source", pa.string()), ("part", pa.int32()), ("until", pa.int64()), ("md5", pa.list_(pa.string()))])


class _Newest(StatefulProcessor):
    """Rows whose text is not among the newest of their source; the list of these is cut when it has grown too long.

    A key is a bucket of sources, and what it remembers of them one packed value: a call into the engine takes longer than
    all the work on a source's few rows.
    """

    def __init__(self, most: int, kept: int, idle_ms: int) -> None:
        self.most, self.kept, self.idle_ms = most, kept, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getValueState("texts", "packed binary, clean_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, state, opened, kept = timerValues.getCurrentWatermarkInMs(), self.texts.get(), {}, []
        memory, rows = self._memory(state, now), pd.concat(rows, ignore_index=True)
        owners, texts = list(zip(rows["source"], rows["part"])), rows["content_md5"].tolist()
        seen_at = np.where(rows["timed"].astype(bool), np.maximum(rows["us"] // 1000, now), now).tolist()
        for i in np.lexsort((rows["number"], rows["numbered"])).tolist():
            owner = owners[i]
            if owner not in opened:
                until, held = memory.get(owner, (now, []))
                opened[owner] = [until, held, set(held)]
            entry = opened[owner]
            entry[0] = max(entry[0], seen_at[i] + self.idle_ms)
            if texts[i] in entry[2]:
                continue
            kept.append(i)
            entry[1].append(texts[i])
            entry[2].add(texts[i])
            if len(entry[1]) > self.most:
                entry[1] = entry[1][-self.kept:]
                entry[2] = set(entry[1])
        self._remember(memory | {owner: (until, held) for owner, (until, held, _) in opened.items()}, state[1] if state else None, now)
        if kept:
            yield rows.iloc[kept].drop(columns=["bucket", "part"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        memory = self._memory(self.texts.get(), now)
        if memory:
            self._remember(memory, None, now)
        else:
            self.texts.clear()
        yield from ()

    def _memory(self, state: tuple | None, now: int) -> dict[tuple, tuple[int, list]]:
        """(source, part) with the time it is forgotten at and its texts, without those of which that time has come."""
        held = _unpacked(state[0]) if state else MEMORY_ARROW.empty_table()
        held = held.filter(pc.greater(held["until"], now))
        source, part, until, md5 = (held[c].to_pylist() for c in MEMORY_ARROW.names)
        return dict(zip(zip(source, part), zip(until, md5)))

    def _remember(self, memory: dict[tuple, tuple[int, list]], clean: int | None, now: int) -> None:
        if clean is None:  # silent sources are not cleaned away one by one
            clean = max(min(until for until, _ in memory.values()), now + self.idle_ms // CLEANED)
            self.handle.registerTimer(clean)
        columns = zip(*[(*owner, until, held) for owner, (until, held) in memory.items()])
        self.texts.update((_packed(pa.table([pa.array(c, t) for c, t in zip(columns, MEMORY_ARROW.types)], schema=MEMORY_ARROW)), clean))

    def close(self) -> None:
        pass


def bounded_seen(stream: DataFrame, most: int = MOST, kept: int = KEPT, parts: int = 1, idle: str = "30 days",
                 buckets: int = BUCKETS) -> DataFrame:
    """Drop a text that is among the newest ones of its source: when more than ``most`` are remembered, ``kept`` stay.

    Rows of a batch are taken in the order of ``ingest_seq``.  ``parts`` splits what a source remembers, and its rows, by
    ranges of the text's hash, each with limits of its own, so a busy source is many keys.  A source that was silent for
    ``idle`` of event time is forgotten.  Sources are dealt to ``buckets``.  A bucket's rows of a batch and what it remembers are
    in memory at once, and the latter is written whole: the more sources there are, the more buckets they need.
    Adds ``content_md5``.  Other columns than texts pass as JSON: keys of maps must be texts.
    """
    hashed = _timed(stream.withColumn("content_md5", F.md5("content")), "0 seconds").drop("_ms")
    part = F.floor(F.conv(F.substring("content_md5", 1, 8), 16, 10).cast("bigint") * parts / (1 << 32)).cast("int")
    fixed = ["source", "content_md5", "ingest_seq", "ts"]
    others = {f"c{k}": f for k, f in enumerate(f for f in hashed.schema.fields if f.name not in fixed)}
    texts = [F.to_json(F.struct(F.col(f"`{f.name}`").alias(c)), JSON_EXACT).alias(c) if f.dataType != StringType() else F.col(f"`{f.name}`").alias(c)
             for c, f in others.items()]
    flat = hashed.select("source", "content_md5", *texts, *_numbers(), F.coalesce(part, F.lit(-1)).alias("part"),
                         _bucket("source", part, buckets=buckets).alias("bucket"))
    schema = StructType([f for f in flat.schema.fields if f.name not in ("part", "bucket")])
    rows = flat.groupBy("bucket").transformWithStateInPandas(_Newest(most, kept, _milliseconds(idle)), schema, "append", "eventTime")
    back = _back() | {f.name: F.from_json(c, StructType().add(c, f.dataType), JSON_EXACT)[c] if f.dataType != StringType() else F.col(c)
                      for c, f in others.items()}
    return rows.select(*[back.get(c, F.col(f"`{c}`")).alias(c) for c in hashed.columns])


#: A row of ``changes`` as its processor sees it.  Numbers are never NULL there, as they would become floating ones.
WAITING = "source string, content_hash string, number bigint, numbered boolean, us bigint, timed boolean"
WAITING_ARROW = pa.schema([("source", pa.string()), ("content_hash", pa.string()), ("number", pa.int64()), ("numbered", pa.bool_()),
                           ("us", pa.int64()), ("timed", pa.bool_())])


class _Changed(StatefulProcessor):
    """The rows of a source in the order of time, as far as the watermark has come, that differ from the one before.

    A key is a bucket of sources.  What waits is kept by slices of time, each one value, so that only slices which the
    watermark has reached are read again.
    """

    def __init__(self, slice_ms: int) -> None:
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint", "packed binary")
        self.last = handle.getMapState("last", "known boolean, source string", "content_hash string")
        self.next = handle.getValueState("next", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            frame = frame[frame["content_hash"].notna()]
            late = ~frame["timed"].astype(bool) | (frame["us"] // 1000 <= now)
            if late.any():
                yield self._marked(frame[late], True)
            new.append(frame[~late])
        new = pd.concat(new)
        if new.empty:
            return
        for number, some in new.groupby(new["us"] // 1000 // self.slice_ms):
            table, held = pa.Table.from_pandas(some, WAITING_ARROW, preserve_index=False), self.waiting.getValue((int(number),))
            self.waiting.updateValue((int(number),), (_packed(pa.concat_tables([_unpacked(held[0]), table]) if held else table),))
        first, timer = int(new["us"].min()) // 1000, self.next.get()
        if timer is None or first < timer[0]:
            if timer is not None:
                self.handle.deleteTimer(timer[0])
            self.handle.registerTimer(first)
            self.next.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, ready, following = timerValues.getCurrentWatermarkInMs(), [], []
        for (number,) in sorted(tuple(k) for k in self.waiting.keys()):
            if number * self.slice_ms > now:
                following.append(number * self.slice_ms)
                break
            held = _unpacked(self.waiting.getValue((number,))[0])
            due = pc.less(held["us"], (now + 1) * 1000)
            ready.append(held.filter(due))
            rest = held.filter(pc.invert(due))
            if rest.num_rows:
                self.waiting.updateValue((number,), (_packed(rest),))
                following.append(pc.min(rest["us"]).as_py() // 1000)
            else:
                self.waiting.removeKey((number,))
        if following:
            self.handle.registerTimer(min(following))
            self.next.update((min(following),))
        else:
            self.next.clear()
        if any(part.num_rows for part in ready):
            found = self._different(pa.concat_tables(ready))
            if len(found):
                yield found

    def _different(self, ready: pa.Table) -> pd.DataFrame:
        order = [(c, "ascending") for c in ("source", "us", "numbered", "number")]
        ready = ready.take(pc.sort_indices(ready, sort_keys=order, null_placement="at_start")).to_pandas()
        source = pd.factorize(ready["source"], use_na_sentinel=False)[0]
        first = np.flatnonzero(np.diff(source, prepend=-1))
        before = ready["content_hash"].shift().to_numpy(object, copy=True)
        ends = ready["content_hash"].to_numpy(object)[[*(first[1:] - 1), len(ready) - 1]]
        for k, name, end in zip(first, ready["source"].to_numpy(object)[first], ends):
            owner = (name is not None, name or "")
            before[k] = (self.last.getValue(owner) or (None,))[0]
            if end != before[k]:
                self.last.updateValue(owner, (end,))
        return self._marked(ready[ready["content_hash"].to_numpy(object) != before], False)

    @staticmethod
    def _marked(rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return rows[WAITING_ARROW.names].assign(late=late)

    def close(self) -> None:
        pass


class _Places(StatefulProcessor):
    """Rows of one time with their places, from 1 on, in the order of ``source`` within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = self.used.get()[0] if self.used.exists() else 0
        for row in sorted(rows, key=lambda r: r.source):
            place += 1
            yield Row(**row.asDict(), place=place)
        self.used.update((place,))

    def close(self) -> None:
        pass


def places(stream: DataFrame, time: str = "ts") -> DataFrame:
    """``stream`` with ``place``: rows of one ``time`` are counted across batches, so that time and place name a row.

    The state holds one number per distinct time.  Rows of one time in a batch are ordered by one task.
    """
    schema = StructType([*stream.schema.fields]).add("place", LongType())
    return stream.groupBy(time).transformWithState(_Places(), schema, "append", "none")


def changes(stream: DataFrame, delay: str, text: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """(source, ingest_seq, ts, content_hash, late): rows whose text differs from the previous non-empty one of their source.

    "Previous" is by time, then ``ingest_seq``, whatever the order of arrival: a row waits until the watermark, the latest
    time less ``delay``, has reached it.  A row that comes after that, or has no time, comes out marked ``late`` and is
    compared with nothing.  Empty texts only move time on.  Only ids and hashes pass through here.  Sources are dealt to
    ``buckets``; what a bucket holds ready at once is in memory at once.
    """
    narrow = stream.select("source", "ingest_seq", "ts", F.when(F.length(text) > 0, F.sha2(F.col(text), 256)).alias("content_hash"))
    # A filter here would be moved below the watermark, and empty texts would not move time on: the processor skips them.
    flat = _timed(narrow, delay).select("source", "content_hash", *_numbers(), _bucket("source", buckets=buckets).alias("bucket"))
    found = flat.groupBy("bucket").transformWithStateInPandas(
        _Changed(max(1, _milliseconds(delay) // SLICES)), f"{WAITING}, late boolean", "append", "eventTime")
    return found.select("source", *[c.alias(name) for name, c in _back().items()], "content_hash", "late")


def changed_only(stream: DataFrame, folder: str, text: str = "content", interval: str | None = "1 second",
                 delay: str = "1 hour") -> StreamingQuery:
    """Start writing ``changes`` below ``folder``; ``read_rows`` and ``read_late`` give them back."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with rocksdb(stream.sparkSession):
        return (changes(stream, delay, text).writeStream.format("parquet").partitionBy("late")
                .option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start(f"{folder}/rows"))


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).parquet(f"{folder}/rows").filter("NOT late").drop("late")


def read_late(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).parquet(f"{folder}/rows").filter("late").drop("late")
