"""Karmarkar-Karp differencing of tokenised documents into windows of nearly equal size, levelled to full ones by cuts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer

LENGTH = 2048
END = b"\x01\x00\x00\x00"
#: Documents differenced together: a step costs as much as the group has windows, and each group leaves one rest.
ITEMS_PER_GROUP = 2048
#: Ids of a group held by a worker, 4 bytes each.
IDS_PER_GROUP = 4_000_000
#: Sequence ids of one task.
PER_TASK = 1 << 36

PACKED = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item by multiway differencing.

    A partial partition is a list of ``windows`` sums.  The two whose largest and smallest sums differ most are merged, the
    largest sum of one with the smallest of the other and so on, so that their imbalances oppose each other; what all sums
    have in common is taken off.  An item begins as a partition with one sum.
    """
    # Sums that are still nothing are left out of a partition: only the first ones are held, in falling order.
    parts = [(-int(s), k, np.array([s], np.int64), np.array([k], np.int64)) for k, s in enumerate(sizes.tolist())]
    heapq.heapify(parts)
    above = np.full(2 * len(sizes), -1, np.int64)  # nodes: items, then unions of two sums
    nodes = at = len(sizes)
    while len(parts) > 1:
        (_, _, a, of_a), (_, _, b, of_b) = heapq.heappop(parts), heapq.heappop(parts)
        both = max(0, len(a) + len(b) - windows)  # so many sums of each meet one of the other
        if both:
            one, other = slice(len(a) - both, None), slice(len(b) - both, None)
            new = np.arange(nodes, nodes + both)
            above[of_a[one]] = new
            above[of_b[other][::-1]] = new
            nodes += both
            sums = np.concatenate([a[:len(a) - both], a[one] + b[other][::-1], b[:len(b) - both]])
            of = np.concatenate([of_a[:len(a) - both], new, of_b[:len(b) - both]])
        else:
            sums, of = np.concatenate([a, b]), np.concatenate([of_a, of_b])
        order = np.argsort(-sums, kind="stable")
        sums, of = sums[order], of[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        at += 1
        heapq.heappush(parts, (-int(sums[0]), at, sums, of))
    found = np.full(nodes, -1, np.int64)
    if parts:
        found[parts[0][3]] = np.arange(len(parts[0][3]))
    for k in range(nodes - 1, -1, -1):
        if above[k] >= 0:
            found[k] = found[above[k]]
    return found[:len(sizes)]


def levelled(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start within it, length) that hold every item once, all full or of a power of two.

    As many windows as the items can fill are balanced by ``difference``.  What exceeds the capacity in one is cut off and
    levels those that lack as much.  For what then remains, less than one window, the number of windows rises by the binary
    digits of the rest.
    """
    sizes = np.asarray(sizes, np.int64)
    windows = int(sizes.sum()) // capacity
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
    over: list[tuple[int, int, int]] = []
    if windows:
        of = difference(sizes, windows)
        for k in np.argsort(-sizes, kind="stable").tolist():
            sequences[of[k]].append((k, 0, int(sizes[k])))
        for own in sequences:
            excess = sum(x[2] for x in own) - capacity
            while excess > 0:  # the largest piece gives it up, so that hardly ever more than one is cut
                k, start, length = own.pop(0)
                taken = min(excess, length)
                over.append((k, start + length - taken, taken))
                if length > taken:
                    own.append((k, start, length - taken))
                excess -= taken
    else:
        over = [(k, 0, s) for k, s in enumerate(sizes.tolist())]
    over.sort(key=lambda x: -x[2])
    over.reverse()  # taken from the end: the largest first

    def filled(own: list[tuple[int, int, int]], room: int) -> None:
        while room:
            k, start, length = over.pop()
            taken = min(room, length)
            own.append((k, start, taken))
            if length > taken:
                over.append((k, start + taken, length - taken))
            room -= taken

    rooms = [capacity - sum(x[2] for x in own) for own in sequences]
    for k in sorted(range(windows), key=lambda k: -rooms[k]):
        filled(sequences[k], rooms[k])
    rest = sum(x[2] for x in over)
    for digit in range(rest.bit_length() - 1, -1, -1):
        if rest >> digit & 1:
            sequences.append([])
            filled(sequences[-1], 1 << digit)
    return sequences


def pack(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text",
         per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """Every piece with its ids and place: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its ids and the id 1; ``ids`` are the piece's, little-endian and unsigned with 32 bits.  ``length`` is a
    power of two.  Windows that a long document fills alone are cut off its front; the rest of it and the other documents
    are packed in groups of at most ``per_group``, as they lie in the table: a task tokenises, packs and emits one group
    after the other, so nothing is shuffled, no row is copied for another task, and a lost task is simply run again.
    No sequence is padded: each is full or as long as a power of two.

    A null or empty text is a document of the id 1 alone; a null doc_id stays null; repeated rows are packed each; an empty
    table gives an empty result; other columns are ignored whatever their names.
    """
    if length & length - 1:
        raise ValueError(f"{length} is no power of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        sequence = TaskContext.get().partitionId() * PER_TASK
        held: list[tuple[int | None, int, bytes, int]] = []  # id, first place, ids from there on, ids of the document
        rows: list[tuple] = []
        size = 0

        def group() -> None:
            nonlocal sequence
            for own in levelled(np.array([len(ids) // 4 for _, _, ids, _ in held]), length):
                offset = 0
                for k, start, n in own:
                    doc, first, ids, total = held[k]
                    rows.append((doc, first + start, n, ids[4 * start:4 * (start + n)], total, sequence, offset))
                    offset += n
                sequence += 1
            held.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)],
                                               names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), encode.ids(some.column(1).to_pylist())):
                    ids += END
                    total = len(ids) // 4
                    full = total // length * length
                    for start in range(0, full, length):
                        rows.append((doc, start, length, ids[4 * start:4 * (start + length)], total, sequence, 0))
                        sequence += 1
                    if full < total:
                        held.append((doc, full, ids[4 * full:], total))
                        size += total - full
                    if len(held) >= per_group or size >= IDS_PER_GROUP:
                        group()
                        size = 0
                if rows:
                    yield out()
        group()
        yield out()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(packed, PACKED)
