"""Versions of a case, look-ups, and the case-vault joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def latest(history: DataFrame, key: str = "case_id", order: str = "ingest_seq",
           columns: Sequence[str] | None = None) -> DataFrame:
    """The last row per key, with ``first_seq``, the position at which the key first appeared.

    An aggregate instead of a window: every task first reduces its own rows to one per key, so a key that holds a large
    share of the table does not end up in one task.
    """
    columns = [c for c in (columns or history.columns) if c not in (key, "first_seq")]
    if order not in columns:
        columns.append(order)
    return (history.groupBy(key)
            .agg(F.max_by(F.struct(*columns), order).alias("_last"), F.min(order).alias("first_seq"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in columns], "first_seq"))


def current_writes(history: DataFrame, key: str = "case_id", order: str = "ingest_seq") -> DataFrame:
    """The rows of ``latest`` for wide tables: all columns of the last write per key, and ``first_seq``.

    The winners are found on two narrow columns and joined back, so texts move once at most.  Before an expensive step,
    such as redaction, this leaves only the current writes to it.  Rows that share key and order all stay.
    """
    winners = history.groupBy(key).agg(F.max(order).alias("_last"), F.min(order).alias("first_seq"))
    winners = winners.withColumnRenamed(key, "_key")
    kept = [c for c in history.columns if c != "first_seq"]
    return (history.join(winners, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_last")))
            .select(*kept, "first_seq"))


def current_cases(history: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Last write per case id wins and keeps the first write's slot (``first_seq``)."""
    columns = [c for c in (columns or history.columns) if c not in ("case_id", "ingest_seq", "first_seq")]
    return current_writes(history.select("case_id", "ingest_seq", *columns))


def current_vault(vault_history: DataFrame) -> DataFrame:
    """The last non-empty mappings per case id; they stay when the case is written again without any."""
    return latest(vault_history.filter(F.size("mappings") > 0), columns=["ingest_seq", "mappings"])


def get_cases(cases: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Point look-up; unknown ids give no row.  ``ids`` is a list or a one-column table of any size."""
    if isinstance(ids, DataFrame):
        return cases.join(ids.select(F.col(ids.columns[0]).alias("case_id")).distinct(), "case_id", "left_semi")
    return cases.filter(F.col("case_id").isin(list(ids)))


def with_mappings(cases: DataFrame, vault: DataFrame, same_version: bool = True) -> DataFrame:
    """Cases with their mappings, NULL where there are none.

    ``same_version`` joins on the write that produced the mappings; otherwise a mapping left from an earlier write of the
    same case would be applied to newer text.
    """
    if not same_version:
        return cases.join(current_vault(vault).select("case_id", "mappings"), "case_id", "left")
    keys = ["case_id", "ingest_seq"]
    # A write may be in the vault twice: after a retry, or merged in under another key.
    return cases.join(vault.groupBy(*keys).agg(F.first("mappings").alias("mappings")), keys, "left")


def _mapped_ids(vault: DataFrame) -> DataFrame:
    return vault.filter(F.size("mappings") > 0).select("case_id").distinct()


def cases_with_pii(cases: DataFrame, vault: DataFrame) -> DataFrame:
    """Cases that ever had mappings."""
    return cases.join(_mapped_ids(vault), "case_id", "left_semi")


def cases_without_pii(cases: DataFrame, vault: DataFrame) -> DataFrame:
    return cases.join(_mapped_ids(vault), "case_id", "left_anti")


def first_copies(df: DataFrame, text: str = "content", order: str = "ingest_seq") -> DataFrame:
    """One row per distinct text, the earliest; ``copies`` tells how many there were.

    Hash, number and count are aggregated, copies combining inside every task; the other columns are joined back, and a
    caller that does not ask for them pays nothing for them.  Of copies with one number each stays.
    """
    columns = [c for c in df.columns if c != "content_md5"]
    hashed = df.withColumn("content_md5", F.md5(text))
    firsts = hashed.groupBy("content_md5").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    if set(columns) <= {order}:
        return firsts.select(order, "content_md5", "copies")
    return hashed.join(firsts, ["content_md5", order]).select(*columns, "content_md5", "copies")


def changed_only(df: DataFrame, text: str = "content", source: str = "source", ts: str = "ts",
                 order: str = "ingest_seq", slice_length: str = "1 hour", before: DataFrame | None = None) -> DataFrame:
    """Rows whose text differs from the previous non-empty one of the same source; empty texts are dropped.

    A busy source is cut into slices of time, so no task sorts a whole source.  The first row of a slice is compared with
    the last row of the source's slice before, taken from a table with one row per source and slice.  ``before`` holds
    (source, last), the hash of the text each source had before these rows.  Rows without a source are one source, rows
    without a time come first.
    """
    number, unit = slice_length.split()
    length = int(number) * SECONDS[unit.rstrip("s")] * 1_000_000
    rows = (df.filter(F.length(text) > 0)
            .withColumn("_hash", F.sha2(F.col(text), 256))
            .withColumn("_slice", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / length)))
    within = W.partitionBy(source, "_slice").orderBy(ts, order)
    rows = rows.withColumn("_before", F.lag("_hash").over(within))
    last = (rows.groupBy(source, "_slice").agg(F.max_by("_hash", F.struct(ts, order)).alias("_last"))
            .withColumn("_carried", F.lag("_last").over(W.partitionBy(source).orderBy("_slice")))
            .select(source, "_slice", "_carried"))
    if before is not None:
        known = before.select(F.col("source").alias("_of"), F.col("last").alias("_known"))
        last = (last.join(known, F.col(source).eqNullSafe(F.col("_of")), "left")
                .select(source, "_slice", F.coalesce("_carried", "_known").alias("_carried")))
    carried = last.select(F.col(source).alias("_of"), F.col("_slice").alias("_at"), "_carried")
    joined = rows.join(carried, F.col(source).eqNullSafe(F.col("_of")) & F.col("_slice").eqNullSafe(F.col("_at")))
    previous = F.coalesce("_before", "_carried")
    return joined.filter(~previous.eqNullSafe(F.col("_hash"))).select(*df.columns)
