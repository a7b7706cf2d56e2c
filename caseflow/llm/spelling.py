"""Spelling variants: words one insertion, deletion or replacement apart, found by PartEnum signatures of letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words have at least so many code points and occurrences; a form is at least so many times as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One of this many (document, word) pairs is misspelt on purpose by ``misspelt``.
MISSPELT_EVERY = 31
#: A replaced letter changes a letter multiset in two places, an inserted or deleted one in one.
DISTANCE = 2
#: Parts of the places of a multiset: all subsets of PARTS - DISTANCE parts are signatures, six here.
PARTS = 4
#: Words counted by a task before it hands them on.
COUNTED_AT_ONCE = 200_000

COUNTS = "word string, n bigint"
KEYS = "key bigint, word string, n bigint, short boolean"


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def misspelt(doc_id: int, word: str) -> str:
    """``word``, or for one of 31 pairs of document and word the word without one of its code points."""
    h = zlib.crc32(f"{doc_id}:{word}".encode("utf-8", "surrogatepass"))
    if h % MISSPELT_EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spoil: bool = False, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the lower-cased letter runs of all texts, each task adding up its own before they are shuffled.

    ``spoil`` puts ``misspelt`` words in; a row without an id then keeps its words as they are.  A null text has no words.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                               names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(RUN.findall(lowered(body))).items() if body else ():
                    if len(word) < least_length:
                        continue
                    if spoil and doc is not None:
                        word = misspelt(doc, word)
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) >= COUNTED_AT_ONCE:
                    yield out()
        yield out()

    counted = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def multiset_signatures(word: str) -> list[int]:
    """PartEnum signatures of the word's letters as a vector of places (letter, which of its kind).

    Places are dealt to PARTS parts by a hash.  Vectors that differ in at most DISTANCE places agree in all but DISTANCE
    parts at least, so the letters of some PARTS - DISTANCE parts are the same: two such words share a signature.
    """
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    seen: Counter[str] = Counter()
    for letter in sorted(word):
        seen[letter] += 1
        parts[zlib.crc32(f"{letter}{seen[letter]}".encode()) % PARTS].append(letter)
    joined = ["".join(p) for p in parts]
    return [zlib.crc32(f"{left}:{'|'.join(joined[i] for i in left)}".encode()) for left in combinations(range(PARTS), PARTS - DISTANCE)]


def halves(word: str, shorter: int) -> list[int]:
    """The first and the last half of a word whose pair's shorter word has ``shorter`` letters.

    One edit lies in one half of the word; the other half, the first shorter // 2 letters or the last of the rest, is the
    same in both words.
    """
    first = shorter // 2
    return [zlib.crc32(f"{shorter}<{word[:first]}".encode()), zlib.crc32(f"{shorter}>{word[len(word) - (shorter - first):]}".encode())]


def _keys(words: DataFrame, longer: bool) -> DataFrame:
    """Rows (key, word, n, short): every signature with every half, as the shorter word of a pair and also as the longer one
    if ``longer``."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                keys, of, short = [], [], []
                some = batch.slice(at, 10_000)
                for k, word in enumerate(some.column(0).to_pylist()):
                    signatures = multiset_signatures(word)
                    for shorter in (len(word), len(word) - 1)[:1 + longer]:
                        for half in halves(word, shorter):
                            keys += [(half - (1 << 31) << 32) | s for s in signatures]
                            of += [k] * len(signatures)
                            short += [shorter == len(word)] * len(signatures)
                taken = some.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), taken.column(0), taken.column(1), pa.array(short, pa.bool_())],
                                                 names=["key", "word", "n", "short"])

    return words.select("word", "n").mapInArrow(keyed, KEYS)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every unordered pair of words one edit apart, once.

    Words meet where they share a signature and a half; what meets is compared in the join itself, so only true pairs
    leave it.  A signature's words are few, as a half of the word must agree too; a join splits the ones that are not.
    """
    a, b = _keys(words, longer=False).alias("a"), _keys(words, longer=True).alias("b")
    # A shorter word with a longer one, or two of one length in their order.
    turned = ~F.col("b.short") | (F.col("a.word") < F.col("b.word"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & turned & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form) by pointer jumping.

    A form is FORM_FACTOR times as frequent as its variant, so chains are no longer than a count has digits and the jumps
    end after five rounds at most.
    """
    now, following = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots"), True
    while following:
        up = now.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        now = stored(now.join(up, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("more")), "roots")
        following = not now.filter("more").isEmpty()
    return now.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of a table (word, n) with one row per word.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is at least FORM_FACTOR times as
    frequent, else null with ``form_n``; ``root`` follows forms to the last.  A word without near words has ``n_near`` 0
    and is its own root.  An empty table gives an empty result; words are kept in the shared folder meanwhile.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.unionAll(pairs.select("other", "other_n", "word", "n"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = stored(words.join(found, "word", "left"), "near-counts")
    often = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    formed = joined.select("word", "n", F.when(often, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(often, -F.col("best.less")).alias("form_n"))
    last = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spoil: bool = False) -> DataFrame:
    """``variants`` of the words of all texts.

    Null and empty texts have no words, repeated rows count each, ties are broken by code-point order, an empty table
    gives an empty result, other columns are ignored whatever their names.  A word as long as a whole text is a word.
    """
    return variants(word_counts(docs, doc_id, text, spoil))
