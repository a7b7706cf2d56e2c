"""One large JSON object per file, cut at its top-level entries by many tasks.

The file is read in byte ranges and in segments that end with a closing brace.  What a segment does to nesting depends on
whether it begins inside a string, so each range is summed up for both cases; the sums of all ranges, one narrow row each, then
tell every range in which state and at which depth it begins.  A segment that comes back to the first level ends an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

RANGE = ["store_file", "block"]


def _braces(pieces: Column, first: int) -> Column:
    """Opening braces in every second piece, from ``first`` on."""
    some = F.array_join(F.filter(pieces, lambda x, i: i % 2 == first), "")
    return F.char_length(some) - F.char_length(F.replace(some, F.lit("{"), F.lit("")))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Rows (store_file, size, block, id, value, bytes, quotes, outside, inside): what a segment adds to the depth if it begins
    outside of a string, and inside one.  ``bytes`` counts the brace that the segment ends with."""
    read = spark.read.option("lineSep", "}").text(path)
    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    quotes = F.size("pieces") - 1
    return (read.select(F.col("_metadata.file_path").alias("store_file"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value",
                        (F.octet_length("value") + 1).cast("long").alias("bytes"), pieces.alias("pieces"))
            .select("store_file", "size", "block", "id", "value", "bytes", quotes.alias("quotes"),
                    (_braces(F.col("pieces"), 0) - F.when(quotes % 2 == 0, 1).otherwise(0)).alias("outside"),
                    (_braces(F.col("pieces"), 1) - F.when(quotes % 2 == 1, 1).otherwise(0)).alias("inside")))


def _before(column: Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """(store_file, slot, json): every top-level entry ``"key": {...}`` of the JSON objects in ``path`` as an object of its own.

    Text that is left after the last entry is a row too, unless it only closes the object, so a file that is cut short or
    is no object shows.  An empty object gives no row.  A file's ranges are cut in parallel; what meets in a task is a range
    or an entry.
    """
    found = staged(_segments(spark, path), "segments")
    within, ranges = Window.partitionBy(*RANGE).orderBy("id"), Window.partitionBy("store_file").orderBy("block")
    in_string = _before(F.col("quotes"), within) % 2
    placed = staged(found.select("*", in_string.alias("_in"), F.sum("bytes").over(within).alias("_to")).select(
        "store_file", "size", "block", "id", "value", "_to", (F.col("_in") + F.col("quotes")).alias("_out"),
        F.sum(F.when(F.col("_in") == 0, F.col("outside")).otherwise(F.col("inside"))).over(within).alias("_outside"),
        F.sum(F.when(F.col("_in") == 0, F.col("inside")).otherwise(F.col("outside"))).over(within).alias("_inside")), "placed")
    last = F.max_by(F.struct("_to", "_out", "_outside", "_inside"), "id")
    # One row per range; within a file they are added up in one task.
    begins = (placed.groupBy(*RANGE).agg(last.alias("x")).withColumn("_begins", _before(F.col("x._out") % 2, ranges) % 2)
              .withColumn("_adds", F.when(F.col("_begins") == 0, F.col("x._outside")).otherwise(F.col("x._inside")))
              .select(*RANGE, "_begins", _before(F.col("_adds"), ranges).alias("_depth"), _before(F.col("x._to"), ranges).alias("_at")))
    closed = F.col("_at") + F.col("_to") <= F.col("size")  # the last segment of a file may end without a brace
    depth = F.col("_depth") + F.when(F.col("_begins") == 0, F.col("_outside")).otherwise(F.col("_inside"))
    ends = closed & ((F.col("_begins") + F.col("_out")) % 2 == 0) & (depth == 1)
    marked = staged(placed.join(begins, RANGE).select(*RANGE, "id", F.when(closed, F.concat("value", F.lit("}"))).otherwise(
        F.col("value")).alias("text"), ends.cast("int").alias("ends")), "marked")
    earlier = marked.groupBy(*RANGE).agg(F.sum("ends").alias("n")).select(*RANGE, _before(F.col("n"), ranges).alias("_earlier"))
    numbered = marked.withColumn("slot", _before(F.col("ends"), within)).join(earlier, RANGE).withColumn("slot", F.col("slot") + F.col("_earlier"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "text")))
    entries = numbered.groupBy("store_file", "slot").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    body = F.regexp_replace("text", r"^[\s{,]+", "")
    return (entries.filter(~F.rlike("text", F.lit(r"^\s*\{?\s*\}?\s*$")))
            .select("store_file", F.col("slot").cast("int").alias("slot"), F.concat(F.lit("{"), body, F.lit("}")).alias("json")))
