"""Collapse repeated log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import once


def _first_per_line(text: Column, pattern: str, label: str) -> Column:
    regex = rf"(?<![^\n])([^\n]*?){pattern}"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_replace(text, regex, f"$1{label}")).otherwise(text)


def normalized_lines(text: Column) -> Column:
    """The text with the first timestamp and the first thread id of every line replaced by a label."""
    stamped = _first_per_line(text, R.LOG_TIMESTAMP, "[TIMESTAMP]")
    return _first_per_line(stamped, R.LOG_THREAD, "[TID]")


def compress_logs(df: DataFrame, text: str = "content", into: str = "content_compressed") -> DataFrame:
    """Keep the first line of every normalised key, then list the repeated keys with their counts.

    A case's lines already sit in one row, so they are grouped by sorting inside the row and nothing is shuffled.
    """
    kept = [c for c in df.columns if c != into]
    # Normalising never changes line breaks, so both arrays line up.
    rows = once(df.withColumn("_normal", normalized_lines(F.col(text))), list(dict.fromkeys([*kept, text])),
                _lines=F.split(F.col(text), "\n", -1), _keys=F.split(F.col("_normal"), "\n", -1))
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(
        "_keys", lambda key, i: F.struct(key.alias("key"), i.alias("pos"))))))
    rows = rows.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (F.get("_sorted", i)["key"] != F.get("_sorted", i - 1)["key"])))
    rows = rows.withColumn("_groups", F.sort_array(F.transform("_starts", lambda start, j: F.struct(
        F.get("_sorted", start)["pos"].alias("pos"),
        F.get("_sorted", start)["key"].alias("key"),
        (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start).alias("n")))))
    firsts = F.transform("_groups", lambda g: F.get("_lines", g["pos"]))
    listed = F.transform(F.filter("_groups", lambda g: g["n"] > 1), lambda g: F.concat(
        F.lit("[REPEATED "), g["n"].cast("string"), F.lit("x] "),
        F.substring(g["key"], 1, R.REPEATED_KEY_CHARS), F.lit("...")))
    packed = F.concat_ws("\n", firsts, F.lit(R.REPEATED_HEADER), listed)
    result = once(rows, [c for c in kept if c != into],
                  _packed=F.when(F.col("_groups").isNotNull(), packed).otherwise(F.col(text)))
    return result.withColumnRenamed("_packed", into)


def log_pattern_counts(df: DataFrame, text: str = "content", case: str = "case_id") -> DataFrame:
    """Per normalised line over all cases: how often it occurs and in how many cases.

    What is counted per line and case is a 128-bit hash of the line.  The lines themselves are shuffled once per task and
    distinct line, and joined by hash.
    """
    lines = df.select(case, F.explode(F.split(normalized_lines(F.col(text)), "\n", -1)).alias("pattern"))
    of = F.unhex(F.md5("pattern")).alias("_hash")
    pairs = lines.select(case, of).groupBy("_hash", case).agg(F.count("*").alias("n"))
    counts = pairs.groupBy("_hash").agg(F.sum("n").alias("occurrences"), F.count(case).alias("cases"))
    patterns = lines.select("pattern").distinct().select("pattern", of)
    return counts.join(patterns, "_hash").select("pattern", "occurrences", "cases")
