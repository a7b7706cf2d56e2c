"""Size-aware heavy-light join of documents by the Jaccard similarity of their word n-grams.

Small sets are compared where they share one of their fixed-size subsets, large sets where an inverted list holds both; the
boundary between the two is chosen by cost.  Both work on prefixes of a global order, rarest n-grams first: two sets that
have at least the fraction t of the larger one in common share k of their first n - ceil(t n) + k n-grams, so k-subsets of
those prefixes (small sets) and their single n-grams (large sets, k = 1) lose no link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lowered_words, mixed, slices, small, stored

#: N-grams of this many words.
WORDS = 4
#: Two documents are linked from this similarity on, in hundredths.
PERCENT = 85
#: Cells of the table of n-gram counts that orders the prefixes, as a power of two.  It is a bounded estimate that every
#: task gets: it decides how many candidates there are, never which links are found.
SKETCH_BITS = 20
#: Rows of the sketch that are summed together.
CELLS_PER_BLOCK = 1 << 14
#: Small sets are enumerated by subsets of this size.
SUBSET = 2
#: The boundary is at most this size; sizes above are one class of the histogram.
LARGEST_SMALL = 256
#: What reading one entry of an inverted list costs, with writing a subset or an entry as 1.
SCAN_COST = 1.0
#: Keys beyond the first that a pair must share before its sets are compared.
SPARE = 2
#: Lists of more entries are settled in rounds before they are paired.
LONG_LIST = 8
#: In a round, each list has this many leaders at most, and each node is compared with this many of them at most.
LEADERS = 4
PROPOSALS = 4
#: Rounds go on while each settles at least this share of the pairs that are left.
GAIN = 0.2
DOCS_PER_BATCH = 256

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a whole text as sorted 64-bit hashes; a shorter text is one n-gram of all its words."""
    found = lowered_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(one))
    total = np.full(len(one) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(_MULTIPLIERS[k % len(_MULTIPLIERS)]) + one[k:len(one) - size + 1 + k])
    return np.unique(total)


def least_common(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """N-grams that a set of ``size`` has in common with any set that it is linked to, at least."""
    return -(-size * percent // 100)


class Order:
    """The global order of n-grams: by estimated count, then by hash."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.shift = counts, np.uint64(64 - int(len(counts)).bit_length() + 1)

    def prefix(self, grams: np.ndarray, length: int) -> np.ndarray:
        count = self.counts[(grams >> self.shift).astype(np.int64)]
        return grams[np.lexsort((grams, count))[:length]]


def keys(grams: np.ndarray, order: Order, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): what a set is looked up by, subsets up to ``boundary`` and n-grams for every set that may meet a larger
    one.  Places are those in the global order; a subset has that of its last n-gram."""
    size = len(grams)
    common = least_common(size, percent)
    found = []
    if size <= boundary:
        some = order.prefix(grams, size - common + SUBSET)
        if len(some) < SUBSET:  # a set of one n-gram: it is its only subset
            found.append((mixed(some ^ np.uint64(1)), np.zeros(len(some), np.int64)))
        else:
            i, j = np.triu_indices(len(some), 1)
            low, high = np.minimum(some[i], some[j]), np.maximum(some[i], some[j])
            found.append((mixed(mixed(low) * np.uint64(_MULTIPLIERS[0]) + high), j))
    if size > least_common(boundary + 1, percent) - 1:
        found.append((order.prefix(grams, size - common + 1), np.arange(size - common + 1)))
    return np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(value), "<i8")


def boundary(counts: np.ndarray, sizes: np.ndarray, percent: int) -> int:
    """The size up to which sets are enumerated by subsets: where the estimated work is least.

    Enumerating costs one entry per subset.  An entry of an inverted list costs writing it and scanning its list, whose
    length is taken from the count of a rare n-gram's cell in relation to the mean cell.
    """
    held = np.sort(counts[counts > 0])
    rare = held[np.searchsorted(np.cumsum(held), held.sum() * (1 - percent / 100))] if len(held) else 1
    scan = 1 + SCAN_COST * max(1.0, rare / max(1.0, held.mean() if len(held) else 1.0))
    n = np.arange(LARGEST_SMALL + 2)
    single = n - least_common(n, percent) + 1
    subsets = np.maximum(1, (single + 1) * single // 2)
    best = min(range(LARGEST_SMALL + 1), key=lambda x: ((sizes * subsets)[1:x + 1].sum() + scan * (
        sizes * single)[max(1, int(least_common(x + 1, percent))):].sum(), x))
    return int(best)


def _encoded(docs: DataFrame, words: int, counted: bool) -> DataFrame:
    """(doc_id, text_key, n, set_key, grams) of (doc_id, text_key, text): the sets as sorted 64-bit hashes in binary.

    With ``counted``, grams stay null and each task adds rows with its n-gram counts in parts (part, counts): cells of
    the sketch, and last the number of sets per size.
    """
    cells = 1 << SKETCH_BITS
    shift = np.uint64(64 - SKETCH_BITS)

    def row(doc: pa.Array, text: pa.Array, found: list[np.ndarray], kept: bool) -> pa.RecordBatch:
        grams = [g.tobytes() for g in found]
        none = pa.nulls(len(found), pa.binary())
        return pa.RecordBatch.from_arrays(
            [doc, text, pa.array([len(g) for g in found], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(g) for g in grams], pa.binary()),
             pa.array(grams, pa.binary()) if kept else none, pa.nulls(len(found), pa.int32()), none],
            names=["doc_id", "text_key", "n", "set_key", "grams", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(cells, np.int64), np.zeros(LARGEST_SMALL + 2, np.int64)
        for batch in batches:
            for some in slices(list(range(batch.num_rows)), DOCS_PER_BATCH):
                part = batch.slice(some[0], len(some))
                found = [shingles(t, words) for t in part.column(2).to_pylist()]
                yield row(part.column(0), part.column(1), found, not counted)
                if counted:
                    counts += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=cells)
                    sizes += np.bincount([min(len(g), LARGEST_SMALL + 1) for g in found], minlength=len(sizes))
        if counted:
            parts = [counts[at:at + CELLS_PER_BLOCK] for at in range(0, cells, CELLS_PER_BLOCK)] + [sizes]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())]
                + [pa.array(range(len(parts)), pa.int32()), pa.array([_packed(x) for x in parts], pa.binary())],
                names=["doc_id", "text_key", "n", "set_key", "grams", "part", "counts"])

    return docs.mapInArrow(run, "doc_id bigint, text_key binary, n bigint, set_key binary, grams binary, part int, counts binary")


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sizes) over all tasks; the parts are summed in parallel, and the result has a fixed size."""
    def total(key: tuple, some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = sum(_unpacked(x) for batch in some for x in batch.column("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(summed)], pa.binary())],
                                         names=["part", "counts"])

    found = {r["part"]: _unpacked(r["counts"]) for r in parts.select("part", "counts").groupBy("part").applyInArrow(
        total, "part int, counts binary").collect()}
    if not found:
        return np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(LARGEST_SMALL + 2, np.int64)
    last = max(found)
    return np.concatenate([found[k] for k in range(last)]), found[last]


def _entries(docs: DataFrame, words: int, percent: int, counts: np.ndarray, limit: int) -> DataFrame:
    """(key, short, n, place) for every key of the set of every row of (doc_id, text_key, text).

    ``short`` is the first half of the set's 128-bit hash: sets that share it are told apart where pairs are verified.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(sent.value)
        for batch in batches:
            for some in slices(list(range(batch.num_rows)), DOCS_PER_BATCH):
                sets = [g for t in batch.column(2).slice(some[0], len(some)).to_pylist() if len(g := shingles(t, words))]
                if not sets:
                    continue
                found = [keys(g, order, percent, limit) for g in sets]
                sizes = [len(k) for k, _ in found]
                short = np.array([_short(xxhash.xxh3_128_digest(g.tobytes())) for g in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.repeat(short, sizes)),
                     pa.array(np.repeat(np.array([len(g) for g in sets], np.int64), sizes)),
                     pa.array(np.concatenate([p for _, p in found]))], names=["key", "short", "n", "place"])

    return docs.mapInArrow(run, "key bigint, short bigint, n bigint, place bigint")


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _sets_of(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(short, node, grams) of the sets that ``pairs`` name: each is read again from one of its documents."""
    wanted = pairs.select(F.explode(F.array("short_a", "short_b")).alias("short")).distinct()
    some = wanted.join(nodes, "short").select(F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("of"), "set_key", "short", "node")
    chosen = texts.join(small(some.select("id", "of").distinct()), (F.col("text_key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    found = _encoded(chosen.select("doc_id", "text_key", "text"), words, counted=False).select("set_key", "grams")
    return found.join(some.select("set_key", "short", "node"), "set_key").dropDuplicates(["node"])


def _linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the linked nodes among the pairs (short_a, short_b); the whole sets decide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_BATCH):
                some, kept = batch.slice(at, DOCS_PER_BATCH), []
                for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = stored(pairs.select("short_a", "short_b"), "pairs")
    sets = stored(_sets_of(pairs, texts, nodes, words), "grams")
    a = sets.select(F.col("short").alias("short_a"), F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    b = sets.select(F.col("short").alias("short_b"), F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(b, "short_b").join(a, "short_a").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a bigint, b bigint")


def _possible(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """N-grams that two linked sets of n and m have in common at least."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _spare(n: Column, m: Column, percent: int, limit: int) -> Column:
    """How many keys more than one two linked sets are asked to share; two small sets share at least one subset.

    They have o n-grams in common or more.  The (k + 1)-th of these, counted from 0, is at a place of at most n - o + k in the
    one set and m - o + k in the other.  So k + 1 keys are shared at places up to n - o + k and m - o + k, as long as these are
    in both prefixes.
    """
    room = _overlap(n, m, percent) - F.ceil(percent * F.greatest(n, m) / 100)
    return F.when(F.greatest(n, m) <= limit, 0).otherwise(F.least(F.lit(SPARE), F.greatest(F.lit(0), room)))


def _unsettled(lists: DataFrame, nodes: DataFrame, joined: DataFrame | None, turn: int | None = None) -> DataFrame:
    """(key, short, n, place, component) of the lists that hold several components; with ``turn`` also their leaders,
    without it also ``first``, the smallest place of all keys that a node shares with any other.

    ``leaders`` are some of a list's nodes, (short, n, component).  Half are those where the key comes first: a text that copies
    were made from has no rare n-grams of its own before it, and most copies are linked to it rather than to each other.  Ties
    and the other half are drawn by hashes that differ from turn to turn but not from list to list: lists that hold the same
    nodes have the same leaders, and the keys that a node shares with one are counted.
    """
    of = nodes.select("short", F.col("node").alias("component")) if joined is None else nodes.join(joined, "node", "left").select(
        "short", F.coalesce("component", "node").alias("component"))
    if turn is None:
        of = of.join(lists.groupBy("short").agg(F.min("place").alias("first")), "short")
    placed = stored(lists.select("key", "short", "n", "place").join(of, "short"), "placed")
    found = [F.min("component").alias("x"), F.max("component").alias("y")]
    if turn is not None:
        hashed = [F.xxhash64("short", F.lit(turn), F.lit(k)) for k in range(LEADERS)]
        found.append(F.array_distinct(F.array(*(F.min_by(F.struct("short", "n", "component"), F.struct("place", x) if k % 2 == 0 else x)
                                                for k, x in enumerate(hashed)))).alias("leaders"))
    return stored(placed.join(placed.groupBy("key").agg(*found).filter("x < y").drop("x", "y"), "key"), "split")


def _left(split: DataFrame) -> tuple[int, int]:
    """(pairs of different components that the lists hold, entries of the lists)."""
    held = split.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    found = held.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
    return int(found[0] or 0), int(found[1] or 0)


def _proposals(split: DataFrame, percent: int, limit: int) -> DataFrame:
    """(short_a, short_b) of nodes and leaders of other components: for each node those with which it shares most keys."""
    pairs = split.select("short", "n", "component", F.col("leaders.short").alias("all"), F.explode("leaders").alias("leader"))
    # Two leaders of a list propose once.
    pairs = pairs.filter((F.col("leader.component") != F.col("component")) & _possible(F.col("n"), F.col("leader.n"), percent)
                         & ((F.col("leader.short") < F.col("short")) | ~F.array_contains("all", F.col("short"))))
    pairs = pairs.groupBy(F.col("leader.short").alias("short_a"), F.col("short").alias("short_b")).agg(
        F.count("*").alias("keys"), F.max("leader.n").alias("n_a"), F.max("n").alias("n_b"))
    pairs = pairs.filter(F.col("keys") > _spare(F.col("n_a"), F.col("n_b"), percent, limit))
    shares_most = Window.partitionBy("short_b").orderBy(F.desc("keys"), "short_a")
    return pairs.withColumn("rank", F.row_number().over(shares_most)).filter(F.col("rank") <= PROPOSALS).select("short_a", "short_b")


def _across(split: DataFrame, percent: int, limit: int) -> DataFrame:
    """(short_a, short_b) of all nodes of different components that share as many keys as a link implies."""
    x, y = split.alias("x"), split.alias("y")
    n, m = F.col("x.n"), F.col("y.n")

    def may(side: str, size: Column) -> Column:
        # As many n-grams as a set may lack come before the first one in common, at most; subsets have other places.
        return (size <= limit) | (F.col(f"{side}.first") <= size - _overlap(n, m, percent))

    # The last place that a key may have: that of the last n-gram of the first subset, or of the first n-grams, in common.
    last = F.when(F.greatest(n, m) <= limit, SUBSET - 1).otherwise(_spare(n, m, percent, limit)) - _overlap(n, m, percent)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                   & _possible(n, m, percent) & may("x", n) & may("y", m) & (F.col("x.place") <= n + last) & (F.col("y.place") <= m + last))
    pairs = pairs.groupBy(F.col("x.short").alias("short_a"), F.col("y.short").alias("short_b")).agg(
        F.count("*").alias("keys"), F.max("x.n").alias("n_a"), F.max("y.n").alias("n_b"))
    return pairs.filter(F.col("keys") > _spare(F.col("n_a"), F.col("n_b"), percent, limit))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, text_key, n_shingles, component_id, first).

    Documents are linked when 100 |A & B| >= percent |A | B| for their sets of distinct word n-grams; ``component_id`` is
    the smallest doc_id of all documents reachable by links, and ``first`` marks one row of each component (smallest
    doc_id, then text_key; of equal rows each is marked).  ``text_key`` is the MD5 of the text.  A text without words, or
    null, has no set, is linked with nothing and keeps its own id.  A null doc_id counts as larger than every other; a
    component of null ids has a null id.  Repeated rows are linked; an empty table gives an empty result; other columns
    are ignored.

    Equal sets are one node.  Keys that only one node has are dropped after a combined count.  Then long lists are settled
    in rounds: leaders of each list are compared with its nodes of other components, a few pairs per node, what is linked
    becomes one component, and lists that hold a single one are done.  When rounds settle little more, or no more pairs are
    left than entries, all pairs of all lists across components that share as many keys as a link implies are compared; the whole sets
    decide.  So a group of linked copies is not expanded into its pairs, and no link that joins components is missed.  Copies
    that are nearly, but not, similar enough, and not linked through others either, are still paired in their lists.  For a
    pair of two sizes only the first places of its prefixes count, those that a link cannot do without.
    """
    whole = F.col(text).cast("string")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(whole, F.lit("")))).alias("text_key"),
                        whole.alias("text"))
    first_pass = stored(_encoded(texts, words, counted=True), "sets")
    rows = first_pass.filter("part is null").select("doc_id", "text_key", "n", "set_key")
    counts, sizes = _summed(first_pass.filter("part is not null"))
    limit = boundary(counts, sizes, percent)

    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = stored(rows.filter("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), best.alias("best"))
                   .withColumn("short", F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Twice from the texts: writing all entries would take more disk than the texts do.
    shared = _entries(texts, words, percent, counts, limit).groupBy("key").agg(
        F.min("short").alias("least"), F.max("short").alias("most"), (F.count("*") > LONG_LIST).alias("long")).filter("least < most")
    lists = stored(_entries(texts, words, percent, counts, limit).join(shared.select("key", "long"), "key").distinct(), "lists")

    links = joined = before = None
    long = lists.filter("long")
    for turn in count():
        split = _unsettled(long, nodes, joined, turn)
        left, entries = _left(split)
        if left <= entries or (before is not None and left > (1 - GAIN) * before):
            break
        more = stored(_linked(_proposals(split, percent, limit), texts, nodes, words, percent), "links")
        if more.isEmpty():
            break
        links = more if links is None else links.unionByName(more)
        joined, before, long = stored(components(links), "components"), left, split.drop("component", "leaders")
    more = stored(_linked(_across(_unsettled(lists, nodes, joined), percent, limit), texts, nodes, words, percent), "links")
    if not more.isEmpty():
        joined = stored(components(more if links is None else links.unionByName(more)), "components")
    if joined is None:
        joined = docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    of = nodes.join(joined, "node", "left").select("set_key", "best", F.coalesce("component", "node").alias("component"))
    named = of.join(of.groupBy("component").agg(F.min("best").alias("chosen")), "component").select("set_key", "chosen")
    with_set = rows.filter("n > 0").join(named, "set_key").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("chosen.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_key") == F.col("chosen.text_key"))).alias("first"))
    without = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                          F.lit(True).alias("first"))
    return with_set.unionByName(without)


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``similar``, whole, with all its columns; texts without words all stay.

    Rows to leave out are found by id and MD5 of the text.  Texts pass through the scan where the list of rows to leave out
    was counted to be short, and through a shuffle where it is long.
    """
    found = stored(similar(docs, doc_id, text, words, percent).filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(
        F.count("*").alias("copies"), F.max("first").alias("first")), "copies")
    key = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    of = F.col(doc_id).cast("long").eqNullSafe(F.col("of_id")) & (key == F.col("of_key"))
    named = found.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    rest = docs.join(small(named.filter("not first").select("of_id", "of_key")), of, "left_anti")
    repeated = small(named.filter("first and copies > 1").select("of_id", "of_key"))
    once = rest.join(repeated, of, "left_semi").withColumn("of_key", key).dropDuplicates([doc_id, "of_key"]).drop("of_key")
    return rest.join(repeated, of, "left_anti").unionByName(once)
