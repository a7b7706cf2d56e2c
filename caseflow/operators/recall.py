"""Matching of cases by their fingerprints: classes of equal ones, and links between classes that share most of their words.

A fingerprint is the set of a text's hashed words.  Cases with equal sets are one class, however many they are, and are never
paired; pairs exist between classes only.  Two classes are linked if the words that they share are at least ``PERCENT`` of the
larger set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

PERCENT = 80
#: Cells of the table of word counts that orders the words, as a power of two.
SKETCH_BITS = 22
LAST_CELL = (1 << SKETCH_BITS) - 1
#: Sets are compared in bands by the size of the larger one: (more words than this, longs of a signature).
BANDS = ((0, 4), (256, 8), (512, 16), (1024, 32), (2048, 64))
#: With each word of a prefix go some words before it: (steps less in count, so many of the first words from there on).
EARLY = ((0, 4), (1, 2), (2, 2))
N_EARLY = sum(n for _, n in EARLY)
#: Steps in which counts are told apart there, for each doubling.
STEPS = 2
#: The list of a word that more sets may hold is dealt into parts.
LONGEST = 20_000
SETS_PER_BATCH = 256
PAIRS_AT_ONCE = 1 << 18
WORDS_AT_ONCE = 1 << 20
#: Of so many pairs, a list of candidates is dealt into parts.
PAIRS_PER_PART = 20_000
#: A group of so many pairs is verified as one product, if so much of it is paired and its tables have no more cells.
LARGE_GROUP, DENSE, LARGEST_TABLE = 200, 8, 1 << 24
LONGS_AT_ONCE = 4


def word_set(fingerprint: Column) -> Column:
    """A fingerprint as sorted 64-bit numbers, in which two of a text's few words do not meet."""
    return F.array_sort(F.array_distinct(F.transform(fingerprint, lambda x: F.xxhash64(x))))


def _word_sets(prints: DataFrame, case: str, fingerprint: str) -> DataFrame:
    words = word_set(F.coalesce(fingerprint, F.array().cast("array<string>")))
    return prints.select(F.col(case).alias("case"), words.alias("words")).withColumn(
        "digest", F.sha2(F.array_join(F.col("words").cast("array<string>"), ","), 256))


def _class_words(sets: DataFrame) -> DataFrame:
    """(class_id, n_cases, words), staged: copies combine inside every task, so words move once."""
    found = sets.groupBy("digest").agg(F.min("case").alias("class_id"), F.count("*").alias("n_cases"), F.first("words").alias("words"))
    found = staged(found.filter("class_id IS NOT NULL"), "classes")
    # A case that is given twice may name two classes: it stands for one of them.
    twice = found.groupBy("class_id").agg(F.min("digest").alias("_kept"), F.count("*").alias("_n")).filter("_n > 1")
    if not twice.isEmpty():
        found = found.join(twice, "class_id", "left").filter("_kept IS NULL OR _kept = digest")
    return found.select("class_id", "n_cases", "words")


def classes(prints: DataFrame, case: str = "case_id", fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(case, class_id) of every case, and (class_id, n_cases, words) of every class, named by its smallest case.

    Copies are counted on a digest.  A null fingerprint is the empty set.
    """
    sets = staged(_word_sets(prints, case, fingerprint), "word-sets")
    firsts = sets.groupBy("digest").agg(F.min("case").alias("class_id"))
    members = sets.select("case", "digest").join(firsts, "digest").select("case", "class_id")
    return members, _class_words(sets)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common words of a set of ``n`` with one that is not larger."""
    return -(-n * percent // 100)


def sketch(sets: DataFrame) -> DataFrame:
    """(cell, n): how many sets hold a word of the cell.  Its size is bounded, whatever the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LAST_CELL + 1, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("words").flatten().to_numpy() & LAST_CELL, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["cell", "n"])

    return sets.select("words").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _signatures(words: np.ndarray, owner: np.ndarray, sets: int, longs: int) -> np.ndarray:
    """The parities of the numbers of words at ``64 * longs`` places, a row per set: two sets differ in at least as many words
    as parities."""
    bits = 64 * longs
    odd = np.bincount(owner * bits + (words & (bits - 1)), minlength=sets * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(sets, bits), axis=1, bitorder="little").view("<i8")


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _packed(rows: np.ndarray) -> pa.BinaryArray:
    """The rows of a table of numbers as one binary value each."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.ChunkedArray, kind: str, size: int) -> np.ndarray:
    packed = column.combine_chunks()
    _, ends, values = packed.buffers()
    begin = np.frombuffer(ends, np.int32)[packed.offset]
    return np.frombuffer(values, kind, len(packed) * size, int(begin)).reshape(-1, size)


def _early(often: np.ndarray, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of every word of the prefixes, the first ones that are about as often, and so on by ``EARLY``, as far as they come
    before it; else 0.

    Two sets that hold the same word choose alike.  Sets that share most of their words thus mostly know at a shared word that
    they share one before.  Words of one set alone are not chosen.
    """
    step = np.floor(STEPS * np.log2(often)).astype(np.int64)
    wide = 64 * STEPS
    at = np.arange(len(words))
    found = []
    for less, several in EARLY:
        first = np.searchsorted(owner * wide + step, owner * wide + np.maximum(step - less, 1))
        found += [np.where(first + k < at, words[np.minimum(first + k, len(words) - 1)], 0) for k in range(several)]
    return np.stack(found, axis=1)


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(band, class_id, n, prefix, signature): of every class its rarest words, as many as a link cannot do without, once per
    band that a linked class may be the larger of a pair in.

    Two sets that share enough words share one of these, whatever the order, as long as it is the same for all; rare words
    first keeps the lists short.  The order is by the counts of a bounded sketch, which every task gets, so no words move.
    """
    counted = sketch(sets).toArrow()
    counts = np.zeros(LAST_CELL + 1, np.int32)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    kind = sets.schema["class_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_PER_BATCH):
                yield from banded(batch.slice(at, SETS_PER_BATCH))

    def banded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        listed = batch.column("words")
        words = listed.flatten().to_numpy()
        n = listed.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        often = sent.value[words & LAST_CELL]
        order = np.lexsort((words, often, owner))
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        rank_words, rank_often = words[order], often[order]
        for (low, longs), (high, _) in zip(BANDS, [*BANDS[1:], (None, 0)]):
            least = _least(np.maximum(n, low + 1), percent)
            inside = (n > 0) & (n >= least) & (n <= (high or n))
            rows = np.flatnonzero(inside)
            if not len(rows):
                continue
            length = np.where(inside, n - least + 1, 0)
            kept = place < length[owner]
            held = inside[owner]
            number = np.cumsum(inside) - 1
            signature = _signatures(words[held], number[owner[held]], len(rows), longs)
            early = _early(rank_often[kept], rank_words[kept], owner[kept])
            prefix = pa.StructArray.from_arrays(
                [pa.array(rank_often[kept]), pa.array(rank_words[kept]), _packed(early)],
                names=["often", "word", "early"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), low, np.int32)), batch.column("class_id").take(pa.array(rows)), pa.array(n[rows].astype(np.int32)),
                 _listed(prefix, length[rows]), _packed(signature)],
                names=["band", "class_id", "n", "prefix", "signature"])

    return sets.select("class_id", "words").mapInArrow(
        run, f"band int, class_id {kind.simpleString()}, n int, prefix array<struct<often:int,word:bigint,early:binary>>, signature binary")


def _index(found: DataFrame, longest: int) -> DataFrame:
    """(at, band, side, class_id, n, place, early, signature) of prefixes, sorted: every list (at) is in one task, by size.

    A word has a list.  If more than ``longest`` sets may hold the word, the list is dealt into shares, and there is a list for
    any two of them and for each: none is longer than two shares, and every two sets meet in one.  ``side`` tells the shares
    of a list.
    """
    # A word of one class alone leads to nobody.
    each = found.select("band", "class_id", "n", "signature", F.posexplode("prefix").alias("place", "of")).filter("of.often > 1")
    each = each.select("band", "class_id", "n", "signature", "place", "of.*")
    shares = F.ceil(F.col("often") / longest)
    own = F.pmod(F.xxhash64("class_id"), shares)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).alias("side")))
    dealt = F.transform(F.sequence(F.lit(0).cast("long"), shares - 1), lambda x: F.struct(
        (F.least(own, x) * shares + F.greatest(own, x)).alias("part"), F.signum(own - x).cast("int").alias("side")))
    rows = each.select("band", "class_id", "n", "signature", "early", "place", "word",
                       F.inline(F.when(shares > 1, dealt).otherwise(whole)))
    lists = rows.select(F.xxhash64("word", "part").alias("at"), "band", "side", "class_id", "n", "place", "early", "signature")
    return lists.repartition("at").sortWithinPartitions("at", "n")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists (at) of rows that are sorted by list, about one for each batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("at").to_numpy()
        changed = np.flatnonzero(at[1:] != at[:-1])
        cut = int(changed[-1]) + 1 if len(changed) else 0
        if not cut and waiting and waiting[-1].column("at")[-1].as_py() != at[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items whose sizes are at most ``most`` together, or one item each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def _expanded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, number within it) of every element of items of these sizes."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _meetings(part: pa.Table, band: int, longs: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, larger): rows of whole lists of a band whose sets may be linked.

    Sizes, the words that can still be shared from there on, and the signatures decide.  Where a pair shares one of its early
    words, it is taken there and not again.
    """
    at, n, place = (part.column(k).to_numpy().astype(np.int64) for k in ("at", "n", "place"))
    side = part.column("side").to_numpy()
    # Bits are counted without a sign: of a negative number, NumPy counts those of its absolute value.
    signature, early = _unpacked(part.column("signature"), "<u8", longs), _unpacked(part.column("early"), "<i8", N_EARLY)
    group = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
    least = _least(n, percent)
    # The larger set of a pair comes later in the list, and is at most so large.
    largest = (n - place) * 100 // percent
    wide = int(n.max()) + 1
    ends = np.searchsorted(group * wide + n, group * wide + np.minimum(largest, wide - 1), "right")
    counts = np.maximum(ends - np.arange(len(n)) - 1, 0)
    for first, last in _spans(counts, PAIRS_AT_ONCE):
        small, large = _expanded(counts[first:last])
        small += first
        large += small + 1
        near = (n[large] > band) & (place[large] <= n[large] - least[large]) & ((side[small] == 0) | (side[small] != side[large]))
        small, large = small[near], large[near]
        room = n[small] + n[large] - 2 * least[large]
        for k in range(0, longs, LONGS_AT_ONCE):
            odd = np.bitwise_count(signature[small, k:k + LONGS_AT_ONCE] ^ signature[large, k:k + LONGS_AT_ONCE])
            room = room - odd.sum(axis=1, dtype=np.int64)
            near = room >= 0
            small, large, room = small[near], large[near], room[near]
        met = np.zeros(len(small), bool)
        k = 0
        for _, several in EARLY:
            for i, j in product(range(k, k + several), repeat=2):
                met |= (early[small, i] == early[large, j]) & (early[small, i] != 0)
            k += several
        yield small[~met], large[~met]


def _common(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many words the members ``one`` and ``two`` of each pair share; a member's words are ``sizes`` from ``starts`` on."""
    known, number = np.unique(words, return_inverse=True)
    # Words are sorted within a member, so (member, word) is sorted.
    owner, _ = _expanded(sizes)
    held = owner * len(known) + number
    small, large = np.where(sizes[one] <= sizes[two], (one, two), (two, one))
    found = np.zeros(len(one), np.int64)
    for first, last in _spans(sizes[small], WORDS_AT_ONCE):
        pair, k = _expanded(sizes[small[first:last]])
        pair += first
        wanted = large[pair] * len(known) + number[starts[small[pair]] + k]
        hit = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
        found[first:last] = np.bincount(pair[hit] - first, minlength=last - first)
    return found


def _common_of_group(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray | None:
    """The same for a group in which most members are paired with most others, as a product of tables of words; else None."""
    (left, i), (right, j) = np.unique(one, return_inverse=True), np.unique(two, return_inverse=True)
    if len(left) * len(right) > DENSE * len(one):
        return None
    rows = np.concatenate([left, right])
    row, k = _expanded(sizes[rows])
    _, number, often = np.unique(words[starts[rows[row]] + k], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    if len(rows) * len(shared) > LARGEST_TABLE:
        return None
    kept = often[number] > 1
    held = np.zeros((len(rows), len(shared)), np.float32)
    held[row[kept], np.searchsorted(shared, number[kept])] = 1
    return (held[:len(left)] @ held[len(left):].T)[i, j].astype(np.int64)


def _verified(table: pa.Table, percent: int) -> pa.Table:
    """The linked ones of the pairs (at, one, two), on the sets (at, one, words) that are in the same table."""
    pairs = table.column("two").is_valid()
    sets, pairs = table.filter(pc.invert(pairs)), table.filter(pairs)
    codes = pa.chunked_array([*sets.column("one").chunks, *pairs.column("one").chunks, *pairs.column("two").chunks],
                             table.schema.field("one").type).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    _, group = np.unique(np.concatenate([x.column("at").to_numpy() for x in (sets, pairs)]), return_inverse=True)
    wide = int(codes.max()) + 1
    a, b = len(sets), len(pairs)
    key = group[:a] * wide + codes[:a]
    order = np.argsort(key)
    one, two = (order[np.searchsorted(key, group[a:] * wide + x, sorter=order)] for x in (codes[a:a + b], codes[a + b:]))
    listed = sets.column("words").combine_chunks()
    sizes = listed.value_lengths().to_numpy().astype(np.int64)
    members = np.cumsum(sizes) - sizes, sizes, listed.flatten().to_numpy()
    common = np.zeros(b, np.int64)
    rest = np.ones(b, bool)
    for large in np.flatnonzero(np.bincount(group[a:]) >= LARGE_GROUP):
        some = np.flatnonzero(group[a:] == large)
        if (found := _common_of_group(*members, one[some], two[some])) is not None:
            common[some], rest[some] = found, False
    common[rest] = _common(*members, one[rest], two[rest])
    linked = pa.array(common * 100 >= np.maximum(sizes[one], sizes[two]) * percent)
    found = pairs.select(["one", "two"]).append_column("common", pa.array(common.astype(np.int32))).filter(linked)
    return found.combine_chunks()


def candidates(sets: DataFrame, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """(one, two, at) of classes that may be linked, each pair once, and a list that they met in.

    What meets in the index is kept only if it may be linked; that is decided where classes meet, so pairs without a link are
    on no disk.
    """
    longs = dict(BANDS)
    kind = sets.schema["class_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            for band in table.column("band").unique().to_pylist():
                part = table.filter(pc.equal(table.column("band"), band))
                at, ids = part.column("at").combine_chunks(), part.column("class_id").combine_chunks()
                for small, large in _meetings(part, band, longs[band], percent):
                    yield pa.RecordBatch.from_arrays([at.take(pa.array(small)), ids.take(pa.array(small)), ids.take(pa.array(large))],
                                                     names=["at", "one", "two"])

    met = _index(prefixes(sets, percent), longest).mapInArrow(run, f"at bigint, one {kind}, two {kind}")
    return met.groupBy(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).agg(F.min("at").alias("at"))


def _dealt(pairs: DataFrame, most: int) -> DataFrame:
    """(at, one, two): a list with more pairs than ``most`` is dealt into parts by the classes on both sides."""
    long = pairs.groupBy("at").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    shares = F.coalesce(F.ceil(F.sqrt(F.col("_n") / most)), F.lit(1))
    part = F.xxhash64("at", F.pmod(F.xxhash64("one"), shares), F.pmod(F.xxhash64("two"), shares))
    return pairs.join(long, "at", "left").select(F.when(F.col("_n").isNull(), F.col("at")).otherwise(part).alias("at"), "one", "two")


def links(sets: DataFrame, percent: int = PERCENT, longest: int = LONGEST, most: int = PAIRS_PER_PART) -> DataFrame:
    """(class_id, other_id, common) of linked classes, each pair once, ``class_id`` the smaller.

    Candidates are verified on the whole sets, which move once for each list that a class has candidates in, not for each pair.
    """
    pairs = _dealt(staged(candidates(sets, percent, longest), "candidates"), most)
    kind = sets.schema["class_id"].dataType.simpleString()
    members = pairs.select("at", F.explode(F.array("one", "two")).alias("class_id")).distinct()
    whole = members.join(sets.select("class_id", "words"), "class_id")
    rows = (whole.select("at", F.col("class_id").alias("one"), F.lit(None).cast(kind).alias("two"), "words")
            .unionAll(pairs.select("at", "one", "two", F.lit(None).cast("array<bigint>").alias("words"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield from _verified(table, percent).to_batches()

    found = rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, f"one {kind}, two {kind}, common int")
    return found.select(F.col("one").alias("class_id"), F.col("two").alias("other_id"), "common")


def fingerprint_match(prints: DataFrame, case: str = "case_id", fingerprint: str = "fingerprint",
                      percent: int = PERCENT) -> DataFrame:
    """(class_id, n_cases, n_links, n_classes): every class with its number of cases, the other cases that each of them is
    linked with (those of its own class too), and the number of linked classes.

    Cases without any word are a class that is linked with nothing, not even with itself; repeated rows count each; an empty
    table gives an empty result; other columns are ignored.
    """
    sets = _class_words(_word_sets(prints, case, fingerprint))
    found = staged(links(sets, percent), "links")
    sizes = sets.select(F.col("class_id").alias("_of"), F.col("n_cases").alias("_n"))
    both = found.select("class_id", "other_id").unionAll(found.select(F.col("other_id"), F.col("class_id")))
    counted = (both.join(sizes, F.col("other_id") == F.col("_of")).groupBy("class_id")
               .agg(F.sum("_n").alias("_cases"), F.count("*").alias("n_classes")))
    own = F.when(F.size("words") > 0, F.col("n_cases") - 1).otherwise(0)
    return sets.join(counted, "class_id", "left").select(
        "class_id", "n_cases", (own + F.coalesce("_cases", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"))
