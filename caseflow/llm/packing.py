"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, stored
from .tokens import tokenizer

LENGTH = 2048
END = b"\x00\x00\x00\x00"
#: Pieces packed together: the group's pieces (six numbers each) are in one task's memory.  The number of groups follows
#: the data; smaller groups waste more, about one unfilled sequence each.
PIECES_PER_GROUP = 200_000
#: The tasks that pack; with fewer pieces than this for each, one group is packed alone.
LEAST_PER_GROUP = 20_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the id 0, cut where longer than ``length``.

    All pieces but the first are then exactly ``length`` long.  Texts do not leave their task.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1).to_pylist())):
                ids += END
                total = len(ids) // 4
                start, end = 0, (total - 1) % length + 1
                piece = 0
                while start < total:
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start:4 * end])))
                    piece, start, end = piece + 1, end, end + length
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(cut, PIECES)


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in order: where the sum over all gaps of (open bins with the gap) squared becomes least.

    Moving a bin from gap g to g - s changes the sum by 2 (n[g - s] - n[g]) + 2, filling it by 1 - 2 n[g], and a new bin
    by 2 n[capacity - s] + 1.  Among equals the smallest gap that is left wins, and a new bin comes last.
    """
    bins = np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 60
    used = 0
    for k, s in enumerate(sizes.tolist()):
        left = capacity - s
        if left:
            have = count[s:capacity]
            change = 2 * (count[:left] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = never
            i = int(change.argmin())
            if change[i] <= 2 * count[left] + 1:
                at = waiting[s + i].pop()
                count[s + i] -= 1
                left = i
            else:
                at, used = used, used + 1
            if left:
                count[left] += 1
                waiting[left].append(at)
        else:
            at, used = used, used + 1
        bins[k] = at
    return bins


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    Items are placed from the largest to the smallest; then the items of all bins that are not full are taken out and
    placed again, as long as that saves a bin.
    """
    bins = np.empty(len(sizes), np.int64)
    todo = np.argsort(-sizes, kind="stable")
    full, opened = 0, None
    while True:
        found = place(sizes[todo], capacity)
        number = int(found.max()) + 1 if len(found) else 0
        if opened is not None and number >= opened:
            break
        fill = np.bincount(found, sizes[todo], number)
        bins[todo] = found + full
        done = fill == capacity
        # Full bins are numbered first, so that the rest can be numbered anew.
        order = np.concatenate([np.flatnonzero(done), np.flatnonzero(~done)])
        number_of = np.empty(number, np.int64)
        number_of[order] = np.arange(number)
        bins[todo] = number_of[found] + full
        full += int(done.sum())
        opened = number - int(done.sum())
        todo = todo[~done[found]]
        if not len(todo):
            break
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[by_bin])
    starts = ends - sizes[by_bin]
    first = np.r_[True, np.diff(bins[by_bin]) > 0] if len(bins) else np.zeros(0, bool)
    offsets = np.empty(len(sizes), np.int64)
    offsets[by_bin] = starts - np.repeat(starts[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    return bins, offsets


def pack(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text",
         per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Pieces are dealt at random to groups of about ``per_group`` and each group is packed by one task, so hot sources,
    copies and equal lengths spread evenly.  A null or empty text is a document of the id 0 alone; a null doc_id stays
    null; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    cut = stored(pieces(docs, path, length, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = cut.count()
    tasks = cut.sparkSession.sparkContext.defaultParallelism
    groups = max(buckets_for(rows, per_group), min(tasks, rows // LEAST_PER_GROUP), 1)

    def fill(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("row", ignore_index=True)
        found, offsets = packed(some["length"].to_numpy(), length)
        some["sequence_id"] = found + (int(key[0]) << 40)
        some["offset"] = offsets
        return some.drop(columns=["row", "group"])

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fill, PACKED)
