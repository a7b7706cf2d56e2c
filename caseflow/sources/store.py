"""The case store: append-only Parquet, with the JSON exchange form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_instant
from .commits import read_batches, write_batch
from .objects import object_entries

# Field names of the JSON exchange form and the columns they become.
JSON_FIELDS = {
    "caseId": ("case_id", "string"),
    "summary": ("summary", "string"),
    "symptoms": ("symptoms", "array<string>"),
    "environment": ("environment", "map<string,string>"),
    "errorPatterns": ("error_patterns", "array<string>"),
    "tags": ("tags", "array<string>"),
    "contentRedacted": ("content_redacted", "string"),
    "wordCount": ("word_count", "int"),
    "createdAt": ("created_at", "string"),
    "updatedAt": ("updated_at", "string"),
}
JSON_SCHEMA = "map<string,struct<" + ",".join(f"{k}:{t}" for k, (_, t) in JSON_FIELDS.items()) + ">>"


# What a stored case row may hold; columns that a write did not have are NULL.
STORE_SCHEMA = (
    "case_id string, summary string, symptoms array<string>, environment map<string,string>, error_patterns array<string>, "
    "tags array<string>, content_redacted string, word_count int, created_at timestamp, updated_at timestamp, "
    "ingest_seq bigint, discussion array<struct<author:string,timestamp:string>>, token_collision boolean, "
    "content_md5 string, batch_id string, ingest_date date")


def write_case_store(cases: DataFrame, path: str, batch: str | None = None) -> None:
    """Add case rows.  Nothing else is rewritten; ``operators.cases.current_cases`` gives the current state.

    Every writer uses this layout: a committed folder per batch, so that a repeated batch replaces its rows and no writer
    touches another's, and below it one per day, so that a store can be pruned and aged by date.  Without a name a batch is
    a new one.
    """
    write_batch(cases.withColumn("ingest_date", F.to_date("created_at")), path, batch, ["ingest_date"])


def read_case_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all committed batches, with ``STORE_SCHEMA``; no batch can hide another by its columns or folders."""
    return read_batches(spark, path, STORE_SCHEMA)


def to_store_json(cases: DataFrame) -> DataFrame:
    """One JSON object per case, ``{case_id: {...}}``."""
    def value(column: str) -> Column:
        if column in ("created_at", "updated_at"):
            return iso_instant(F.col(column))
        return F.col(column)

    body = F.struct(*[value(column).alias(field) for field, (column, _) in JSON_FIELDS.items()])
    return cases.select(F.to_json(F.create_map("case_id", body)).alias("value"))


def export_case_store_json(cases: DataFrame, path: str) -> None:
    to_store_json(cases).write.mode("overwrite").text(path)


def read_case_store_json(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Cases of JSON stores: one object per file, or with ``whole_file=False`` one object per line.

    An object of any size is read by many tasks, as it is cut at its entries (``objects.object_entries``).
    Text that is not such an object gives a row with ``readable = false`` and no case, instead of vanishing.
    """
    if whole_file:
        read = object_entries(spark, path).withColumnRenamed("json", "value")
    else:
        read = spark.read.text(path).select(F.col("_metadata.file_path").alias("store_file"), F.lit(None).cast("int").alias("slot"), "value")
    parsed = read.select("store_file", "slot", F.from_json("value", JSON_SCHEMA, {"mode": "PERMISSIVE"}).alias("store"))
    rows = parsed.select("store_file", F.col("store").isNotNull().alias("readable"), F.col("slot").alias("_slot"),
                         F.posexplode_outer(F.map_entries("store")).alias("slot", "entry"))
    rows = rows.withColumn("slot", F.coalesce("_slot", "slot")).drop("_slot")
    columns = [F.col(f"entry.value.{field}").alias(column) for field, (column, _) in JSON_FIELDS.items()
               if column not in ("case_id", "created_at", "updated_at")]
    times = [F.try_to_timestamp(f"entry.value.{field}").alias(column)
             for field, (column, _) in JSON_FIELDS.items() if column in ("created_at", "updated_at")]
    return rows.select(F.col("entry.key").alias("case_id"), *columns, *times, "store_file", "slot", "readable")


def memory_store(cases: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """A store for the session only: a temporary view, optionally cached."""
    kept = cases.persist() if keep else cases
    kept.createOrReplaceTempView(name)
    return kept


def store_size(spark: SparkSession, path: str) -> int:
    """Bytes of the stored files, 0 if there are none.  Lists the files without opening them."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length"))
    except AnalysisException:
        return 0
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
