"""Phrase search through a stored index of trigrams: only cases that can hold a phrase are compared with it.

The index has two tables of committed batches.  ``postings`` holds one row per write of a case and distinct trigram of its
search fields, ``grams`` how many writes of the batch hold a trigram.  A batch of writes is indexed once, when it is stored;
nothing else is rewritten.  Long posting lists stay rows, so a trigram of every text is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import committed, read_batches, write_batch
from .search import BATCH_COLUMNS, DEFAULT_LIMIT, hits_of, lowered_fields, numbered, top_per_query

#: Folders that the trigrams of a batch are dealt to; a look-up reads those of its trigrams.
PARTS = 64
#: Trigrams looked up per phrase, the rarest ones.
LOOKED_UP = 3
POSTINGS = "part int, gram string, write_no bigint"
COUNTS = "part int, gram string, n bigint"
PHRASE = "struct<query_no:int,query:string,needle:string>"
#: Looked-up trigrams of all phrases together that are broadcast; more are joined as sizes decide.
BROADCAST_ROWS = 100_000


def grams_of(lowered: Column) -> Column:
    """Every three neighbouring characters of a text, with repeats; none of a shorter one or NULL."""
    return F.coalesce(F.regexp_extract_all(lowered, F.lit("(?s)(?=(...))"), F.lit(1)), F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _write_no() -> Column:
    """The number of the write; that two share one, or have none, adds a comparison, never a result."""
    return F.coalesce("ingest_seq", F.lit(-1).cast("bigint"))


def postings(writes: DataFrame) -> DataFrame:
    """(part, gram, write_no), one row per write and distinct trigram within one of its fields or their elements."""
    parts = []
    for name, value in lowered_fields().items():
        whole = name in ("summary", "content")
        each = grams_of(value) if whole else F.flatten(F.transform(value, grams_of))
        parts.append(F.coalesce(each, F.array().cast("array<string>")))
    rows = writes.select(_write_no().alias("write_no"), F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))
    return rows.select(_part(F.col("gram")).alias("part"), "gram", "write_no")


def index_writes(writes: DataFrame, path: str, batch: str) -> None:
    """Index a batch of case writes; a repeated batch replaces itself.

    Rows are ranged by trigram and write, so a frequent trigram covers many files, and file statistics find a rare one.
    """
    spark = writes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("part", "gram", "write_no")
    write_batch(postings(writes).repartitionByRange(tasks, *order).sortWithinPartitions(*order), f"{path}/postings", batch, ["part"])
    mine = [c for c in committed(spark, f"{path}/postings") if c.batch == batch]
    counts = read_batches(spark, f"{path}/postings", POSTINGS, mine).groupBy("part", "gram").agg(F.count("*").alias("n"))
    write_batch(counts.repartition("part"), f"{path}/grams", batch, ["part"])  # a row per trigram: one file a folder


def _needles(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(numbered(queries), "query_no int, query string").withColumn("needle", F.lower("query"))


def _looked_up(index: str, needles: DataFrame) -> list[tuple]:
    """(query_no, part, gram, bit, all bits) of the rarest trigrams of each phrase.

    What reaches the driver is bounded by the letters of the phrases, which came from there.
    """
    asked = needles.select("query_no", F.explode(F.array_distinct(grams_of(F.col("needle")))).alias("gram"))
    asked = asked.withColumn("part", _part(F.col("gram"))).collect()
    counts = _of(read_batches(needles.sparkSession, f"{index}/grams", COUNTS), {(r.part, r.gram) for r in asked})
    known = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    of_phrase: dict[int, list] = {}
    for row in sorted(asked, key=lambda r: (known.get(r.gram, 0), r.gram)):
        of_phrase.setdefault(row.query_no, []).append(row)
    rarest = {number: rows[:LOOKED_UP] for number, rows in of_phrase.items()}
    return [(number, r.part, r.gram, 1 << i, (1 << len(rows)) - 1) for number, rows in rarest.items() for i, r in enumerate(rows)]


def _of(table: DataFrame, grams: set[tuple[int, str]]) -> DataFrame:
    """The rows of some trigrams: their folders are read, and of these the row groups that can hold one."""
    return table.filter(F.col("part").isin(sorted({p for p, _ in grams})) & F.col("gram").isin(sorted({g for _, g in grams})))


def candidates(spark: SparkSession, index: str, queries: Sequence[str]) -> DataFrame:
    """(write_no, wanted): the writes that hold all looked-up trigrams of a phrase, with the phrases.

    Every write that holds a phrase of three characters or more is there; shorter phrases have no trigram and are not.
    A list of phrases per write is the longest group.
    """
    needles = _needles(spark, queries)
    rows = _looked_up(index, needles)
    looked_up = spark.createDataFrame(rows, "query_no int, part int, gram string, bit int, bits int").drop("part")
    few = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda small: small
    held = _of(read_batches(spark, f"{index}/postings", POSTINGS), {(r[1], r[2]) for r in rows}).join(few(looked_up), "gram")
    held = held.groupBy("write_no", "query_no").agg(F.bit_or("bit").alias("seen"), F.max("bits").alias("bits"))
    both = held.filter("seen = bits").join(few(needles), "query_no")
    return both.groupBy("write_no").agg(F.collect_list(F.struct("query_no", "query", "needle")).alias("wanted"))


def search_indexed(cases: DataFrame, index: str, queries: Sequence[str], limit: int = DEFAULT_LIMIT,
                   accumulate: bool = False) -> DataFrame:
    """``search.search_batch`` over current cases whose writes are indexed, with the same result.

    The rarest trigrams of a phrase name the cases that can hold it; only these are lower-cased and compared, each with its
    own phrases.  A phrase under three characters is compared with every case.  Writes that are not indexed are not found by
    longer phrases; a write that is no longer current is found and not joined.
    """
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    spark = cases.sparkSession
    short = _needles(spark, queries).filter(F.size(grams_of(F.col("needle"))) == 0).collect()
    everywhere = F.array(*[F.struct(F.lit(r.query_no).alias("query_no"), F.lit(r.query).alias("query"), F.lit(r.needle).alias("needle"))
                           for r in short]).cast(f"array<{PHRASE}>")
    named = candidates(spark, index, queries).withColumnRenamed("write_no", "_key").withColumnRenamed("wanted", "_named")
    met = cases.withColumn("_write", _write_no()).join(named, F.col("_write") == F.col("_key"), "left" if short else "inner")
    wanted = F.concat(everywhere, F.coalesce(F.col("_named").cast(f"array<{PHRASE}>"), F.array().cast(f"array<{PHRASE}>")))
    hits = hits_of(met.withColumn("_wanted", wanted), accumulate)
    return top_per_query(hits, limit).select(*BATCH_COLUMNS)
