"""Raw case text in, context documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.stateful import places

# Files of one time that numbers keep apart, and the instant from which they count: 2020-01-01.
FILES_PER_TIME = 1 << 22
FIRST_MILLIS = 1577836800000


def _cases(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("ts"),
                     F.lit(None).cast("string").alias("given_case_id"), F.col("value").alias("content"))


def _number(place: Column) -> Column:
    return ((F.unix_millis("ts") - FIRST_MILLIS) * FILES_PER_TIME + place).alias("ingest_seq")


def read_case_files(spark: SparkSession, path: str) -> DataFrame:
    """One file is one case.  ``ingest_seq`` orders the files by modification time, then by path, without ties.

    Files of one time are ranked by path from the listing alone; the texts are not read for it.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"), F.col("modificationTime").alias("ts"))
    ranked = listed.withColumn("_place", F.row_number().over(Window.partitionBy("ts").orderBy("_path")))
    numbered = ranked.select(F.regexp_replace("_path", "^file:/+", "/").alias("_path"), _number(F.col("_place")))
    cases = _cases(spark.read.text(path, wholetext=True))
    return (cases.join(numbered, F.regexp_replace(F.url_decode(F.replace("source", F.lit("+"), F.lit("%2B"))), "^file:/+", "/") == F.col("_path"))
            .select("source", "ingest_seq", "ts", "given_case_id", "content"))


def stream_case_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The streaming form of ``read_case_files``: new files in a folder become new cases.

    Files of one time are counted as they arrive, in the engine's state, and in the order of their paths where they arrive
    together: no two share a number, and a folder that is complete when the stream starts gets the numbers of the batch form.
    The query is started inside ``streaming.stateful.rocksdb``, as a monitor does by itself.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return places(_cases(reader.load(path))).select("source", _number(F.col("place")), "ts", "given_case_id", "content")


def context_json(pack: DataFrame) -> DataFrame:
    """Context documents as JSON text."""
    return pack.select(F.to_json(F.struct(*pack.columns)).alias("json"))


def export_context_json(pack: DataFrame, path: str) -> None:
    pack.write.mode("overwrite").json(path)
