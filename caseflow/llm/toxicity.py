"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import PARTS, count_parts, mixed, stored, summed_parts

#: Features are hashed to 2 ** BITS places.
BITS = 20
#: Distances at which two words form a feature: 1 is the bigram, more are skip-grams.  Single words come besides.
GAPS = (1, 2, 3)
#: At most so many labelled documents are learned from: the first ones by a hash of their id.
TRAIN_ROWS = 24_000
EPOCHS = 4
#: Texts of a batch that are in a worker as Python strings at one time.
TEXTS_AT_ONCE = 256
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.0

#: A-Z to lower case, other ASCII characters than letters and digits to a space; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Places of the words, bigrams and skip-grams of a whole text; repeats are not removed."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint32)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = [mixed(one)]
    found += [mixed(one[:-gap] * np.uint64(0x9E3779B97F4A7C15) + mixed(one[gap:] + np.uint64(gap))) for gap in GAPS if len(one) > gap]
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.uint32)


class Ftrl:
    """Per-coordinate learning rates; a weight is zero until its gradients outweigh the L1 penalty."""

    def __init__(self, size: int, bias: float) -> None:
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), bias

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether a row belongs to the fold that is never learned from; rows without an id do not."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, places, weights) learned from at most ``rows`` labelled documents that are not held out.

    Labels that are null, or whose document is missing, are ignored; of several labels of one document the largest
    counts.  Texts become feature places in parallel.  A place that n documents have gathers gradients of at most n * EPOCHS;
    up to the L1 penalty its weight stays zero, so such places, nearly all, are dropped.  One task then learns from what is
    left of the bounded sample, in hash order.  Without any labelled document there are no weights and the bias says "not
    toxic".
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    sample = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(begin, TEXTS_AT_ONCE)
                found = [np.unique(features(t)).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())],
                                                 names=["turn", "y", "at"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(y, np.frombuffer(at, np.uint32)) for batch in batches
                    for y, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        positive = sum(y for y, _ in examples)
        model = Ftrl(1 << BITS, float(np.log((positive + 0.5) / (len(examples) - positive + 1))))
        for _ in range(EPOCHS):
            for y, at in examples:
                model.learn(at, y)
        weights = model.weights(slice(None))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[model.bias, weights[at]])],
                                         names=["at", "weight"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), texts["id"] == sample["doc_id"])  # bounded: ``rows`` rows at most
    examples = stored(chosen.select("turn", "y", "text").mapInArrow(hashed, "turn bigint, y int, at binary"), "examples")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for at in batch.column(2).to_pylist():
                seen[np.frombuffer(at, np.uint32)] += 1
        yield count_parts(seen)

    seen = summed_parts(examples.mapInArrow(counted, PARTS))
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(seen * EPOCHS > L1))

    def mattering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matter = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            kept = [(x := np.frombuffer(at, np.uint32))[matter[x]].tobytes() for at in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["turn", "y", "at"])

    if len(seen):
        examples = examples.mapInArrow(mattering, "turn bigint, y int, at binary")
    model = examples.repartition(1).sortWithinPartitions("turn", "at").mapInArrow(learned, "at bigint, weight double").toPandas()
    bias = float(model.loc[model["at"] < 0, "weight"].iloc[0]) if len(model) else -1.0
    model = model[model["at"] >= 0]
    return bias, model["at"].to_numpy(), model["weight"].to_numpy()


def scorer(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]):
    """A column function: text to a score from 0 to 1.  The weights, 2 ** BITS at most and mostly zero, go to every task."""
    bias, at, weights = model
    sent = docs.sparkSession.sparkContext.broadcast((bias, at.astype(np.int64), weights))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, at, weights = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        for batch in batches:
            out = np.empty(len(batch))
            for begin in range(0, len(batch), TEXTS_AT_ONCE):
                for k, text in enumerate(batch.slice(begin, TEXTS_AT_ONCE).to_pylist(), begin):
                    found = features(text)
                    found = found[dense[found] != 0]
                    out[k] = bias + dense[np.unique(found)].sum()
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text; all rows and columns stay.

    Null and empty texts get the score of the bias.  Repeated rows and ids get equal scores for equal texts; an empty
    table gives an empty result; an existing column ``score`` or ``predicted`` is replaced.
    """
    of = scorer(docs, train(docs, labels, doc_id, text, label, rows))
    scored = docs.withColumn("score", of(F.col(text).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with their own columns."""
    return docs.filter(scorer(docs, train(docs, labels, doc_id, text, label, rows))(F.col(text).cast("string")) < 0.5)
