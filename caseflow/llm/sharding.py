"""Proportional stratified interleaving: shards that repeat the mixture of sources, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, fraction_below, stored

SHARDS = 8
SEED = "shard-1"
#: Rows ranked together in one group; the number of groups follows the data.
ROWS_PER_BUCKET = 100_000
#: Never fewer groups than this many per shuffle partition, so that a small table is dealt evenly too.
GROUPS_PER_TASK = 4


def shard(docs: DataFrame, shards: int = SHARDS, source: str = "source", doc_id: str = "doc_id", text: str = "text",
          seed: str = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each row's shard and place: (doc_id, source, size, text_crc32, fraction, shard, slot).

    Rows are shuffled by a seeded hash and ranked within their source; rank r of n gets the fraction (2r - 1) / 2n.  All
    rows in order of their fraction are cut into ``shards`` runs whose lengths differ by one at most, so each run holds
    every source in proportion, give or take one row.

    Neither ranking holds a source in one task: rows are ranked within hash ranges (first order) and fraction ranges
    (second order), and what lies before a range comes from its small table of counts.  Null sources are a source of
    their own; null texts have size 1 and the CRC of no bytes; ties and repeated rows are ordered by every column that is
    returned, so equal rows may swap places and nothing else; an empty table gives an empty result.  Other columns of
    ``docs`` are ignored.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary")).alias("h"))
    rows = docs.count()
    parts = max(buckets_for(rows, rows_per_bucket), min(GROUPS_PER_TASK * tasks, buckets_for(rows, 64)))

    group = narrow.withColumn("bucket", fraction_below(F.col("h"), parts))
    in_order = Window.partitionBy("source").orderBy("bucket")
    ranges = group.groupBy("source", "bucket").agg(F.count("*").alias("rows")).select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        (F.sum("rows").over(in_order) - F.col("rows")).alias("before"),
        F.sum("rows").over(Window.partitionBy("source")).alias("n"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = group.withColumn("r", F.row_number().over(within)).join(
        ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    fraction = (2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("n"))
    placed = stored(ranked.select("doc_id", "source", "size", "text_crc32", "h", fraction.alias("fraction")), "fractions")

    cut = placed.withColumn("bucket", F.floor(F.col("fraction") * parts).cast("long"))
    counts = cut.groupBy("bucket").agg(F.count("*").alias("rows"))
    before = counts.select(F.col("bucket").alias("at"),
                           (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("before"))
    order = Window.partitionBy("bucket").orderBy("fraction", "h", "source", "doc_id", "text_crc32", "size")
    place = cut.withColumn("r", F.row_number().over(order)).join(before, F.col("bucket") == F.col("at"))
    place = place.withColumn("place", F.col("before") + F.col("r") - 1)
    whole = max(rows, 1)
    number = f"(place * {shards} div {whole})"
    first = f"(({number} * {whole} + {shards} - 1) div {shards})"
    return place.select("doc_id", "source", "size", "text_crc32", "fraction", F.expr(number).cast("int").alias("shard"),
                        F.expr(f"place - {first}").alias("slot"))
