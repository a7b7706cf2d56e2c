"""Periodic runs of words: harmonic grids of positions, compared by a difference-cover longest-common-extension index."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and at least two periods.
LEAST_WORDS = 12
#: Every difference modulo MODULUS is one of two members of COVER (a perfect difference set, fixed values).
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words indexed at once (a longer document is indexed alone), and grid points compared at once.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 100_000, 1_000_000

FOUND = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _shifts() -> np.ndarray:
    """For each difference d modulo MODULUS the member of COVER that has d + itself in COVER too."""
    shift = np.full(MODULUS, -1, np.int64)
    for a in COVER:
        for b in COVER:
            shift[(b - a) % MODULUS] = a
    return shift


SHIFT = _shifts()


class Extensions:
    """Longest common extensions in a sequence of numbers: ``of(i, j)`` is how many places are equal from i and j on.

    Only the suffixes at cover positions are sorted, once they are needed.  Two places compare the few words up to where
    both are at cover positions; from there the sorted suffixes' common prefixes answer, by the least of a range.
    Places may be one past the end.  The sequence must end in a number that it does not hold otherwise.
    """

    def __init__(self, sequence: np.ndarray) -> None:
        self.size = len(sequence)
        # Numbers after the end are equal to nothing.
        self.x = np.concatenate([sequence.astype(np.int32), np.iinfo(np.int32).min + np.arange(2 * MODULUS + 1, dtype=np.int32)])

    @cached_property
    def sampled(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(place in the order of suffixes per position, tables of least common prefixes over runs of 1, 2, 4 ... places)."""
        v = MODULUS
        at = np.flatnonzero(np.isin(np.arange(self.size) % v, COVER))
        sample = np.full(self.size + v, len(at), np.int64)  # len(at): past the end, below all others
        sample[at] = np.arange(len(at))
        window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.x, v)[at])
        rank = np.unique(window.view(f"S{4 * v}").ravel(), return_inverse=True)[1].ravel().astype(np.int64) + 1
        levels, step = [np.append(rank, 0)], v
        while len(at) and rank.max() < len(at) and step < self.size:
            after = levels[-1][sample[np.minimum(at + step, self.size)]]
            rank = np.unique(rank * (len(at) + 2) + after, return_inverse=True)[1].ravel().astype(np.int64) + 1
            levels.append(np.append(rank, 0))
            step *= 2
        order = np.argsort(rank, kind="stable")
        # Common prefixes of neighbours: the longest equal stretches first, then word by word.
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            r = levels[level]
            same = r[sample[np.minimum(a + common, self.size)]] == r[sample[np.minimum(b + common, self.size)]]
            common += same * (v << level)
        common += self.direct(a + common, b + common, np.full(len(a), v))
        place = np.zeros(self.size + v, np.int64)
        place[at[order]] = np.arange(len(at))
        tables = [common]
        while 2 << (len(tables) - 1) <= len(common):
            last, half = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.minimum(last[:len(last) - half], last[half:]))
        return place, tables

    def direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal places from i and j on, at most ``most``, word by word."""
        same = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        step = 0
        while len(live):
            live = live[self.x[i[live] + step] == self.x[j[live] + step]]
            step += 1
            same[live] = step
            live = live[most[live] > step]
        return same

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        few = (SHIFT[(j - i) % MODULUS] - i) % MODULUS
        same = self.direct(i, j, few)
        # Equal so far and at cover positions now.  What is past the end differs at once.
        on = np.flatnonzero((same == few) & (np.maximum(i, j) + few < self.size))
        if len(on):
            place, tables = self.sampled
            p, q = place[i[on] + few[on]], place[j[on] + few[on]]
            low, high = np.minimum(p, q), np.maximum(p, q)
            k = np.frexp((high - low).astype(float))[1] - 1
            least = np.empty(len(on), np.int64)
            for level in np.unique(k).tolist():
                of = np.flatnonzero(k == level)
                least[of] = np.minimum(tables[level][low[of]], tables[level][high[of] - (1 << level)])
            same[on] += least
        return same


def _grids(lengths: list[int], starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period): for each period up to half a document its multiples, each one period from the next."""
    held, size = [], 0
    for n, start in zip(lengths, starts):
        periods = np.arange(1, n // 2 + 1)
        counts = (n - 1) // periods
        ends = np.cumsum(counts)
        at = 0
        while at < len(periods):
            # At least one period, then as many as fit.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            p = np.repeat(periods[at:to], counts[at:to])
            k = np.arange(len(p)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at - 1] if at else 0), counts[at:to])
            held.append((start + k * p, p))
            size += len(p)
            at = to
            if size >= PAIRS_AT_ONCE:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held, size = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def find_runs(documents: list[list[int]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each sequence of numbers (none negative) its runs as rows (start, length, period), by start, then period.

    A run of period p and two periods at least holds two neighbouring multiples of p whose words are equal.  So these are
    extended in both directions, and what reaches p places in all is a run.  Multiples of its smallest period give the same
    stretch, of which the smallest period stays.
    """
    lengths = [len(d) for d in documents]
    starts = (np.cumsum([0, *[n + 1 for n in lengths]]))[:-1].tolist()
    sequence = np.concatenate([np.append(np.asarray(d, np.int64), -1 - k) for k, d in enumerate(documents)] or [np.zeros(0, np.int64)])
    ahead, back = Extensions(sequence), Extensions(np.append(sequence[::-1], -1 - len(documents)))
    found = np.zeros((0, 3), np.int64)
    for i, p in _grids(lengths, starts):
        equal = np.flatnonzero(sequence[i] == sequence[i + p])
        i, p = i[equal], p[equal]
        right = ahead.of(i, i + p)
        left = back.of(len(sequence) - i, len(sequence) - i - p)
        runs = np.flatnonzero((left + right >= p) & (left + right + p >= least))
        new = np.stack([i[runs] - left[runs], left[runs] + right[runs] + p[runs], p[runs]], axis=1)
        found = np.concatenate([found, new])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.r_[True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1)][:len(found)]]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], [*starts, len(sequence)])
    return [found[a:b] - [s, 0, 0] for a, b, s in zip(cuts, cuts[1:], starts)]


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, for one document of ten with its end replaced by a stretch that repeats; one without an id is left."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if not n or doc_id is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS,
                  change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text's words, ordered by start and period, and the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; ``change`` may replace a document's words first.  A run is a stretch
    of at least ``least`` words and two of its smallest periods that no neighbour extends.  Documents of a task are indexed
    together, about ``WORDS_AT_ONCE`` words at a time; nothing is shuffled.

    Null, empty and blank texts have no runs and the empty collapsed text; a null doc_id stays null; repeated rows give a row
    each; an empty table gives an empty result; other columns are ignored whatever their names.  A long text takes memory
    in proportion to its words.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(some: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
            code: dict[bytes, int] = defaultdict()
            code.default_factory = code.__len__
            runs = find_runs([list(map(code.__getitem__, words)) for _, words in some], least)
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in runs]
            texts = [collapsed(words, r).decode("utf-8") for (_, words), r in zip(some, runs)]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array(listed, _RUNS), pa.array(texts, pa.string())],
                                              names=["doc_id", "runs", "collapsed"])

        held, size = [], 0
        for batch in batches:
            ids, texts = batch.columns
            for k in range(batch.num_rows):
                doc, body = ids[k].as_py(), texts[k].as_py()
                words = body.encode("utf-8").split() if body else []
                held.append((doc, change(doc, words) if change else words))
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(find, FOUND)
