"""Statistics over the case store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_TAGS = 10


def total_cases(history: DataFrame) -> DataFrame:
    return history.agg(F.count_distinct("case_id").alias("total_cases"))


def count_cases_with_pii(vault_history: DataFrame) -> DataFrame:
    """Cases that ever had mappings; writing a case again without any does not take it off the count."""
    return (vault_history.filter(F.size("mappings") > 0)
            .agg(F.count_distinct("case_id").alias("cases_with_pii")))


def tag_counts(cases: DataFrame) -> DataFrame:
    """Cases per tag with ``first``, where the tag first appeared: (first_seq, place in the tag list)."""
    return (cases.select("first_seq", F.posexplode("tags").alias("pos", "tag")).groupBy("tag")
            .agg(F.count("*").alias("count"), F.min(F.struct("first_seq", "pos")).alias("first")))


def top_tags(cases: DataFrame, limit: int = TOP_TAGS) -> DataFrame:
    """Most frequent tags; equal counts keep the order of first appearance."""
    return tag_counts(cases).orderBy(F.desc("count"), "first").limit(limit).select("tag", "count")


def stats_of_writes(writes: DataFrame, data_size: int = 0) -> DataFrame:
    """``stats`` from case writes (case_id, ingest_seq, tags, has_pii) in one pass over them.

    Writes are reduced to their case, each case to labelled entries (one for the total, one if it ever had sensitive data, one
    per tag), and the entries to one row per label.
    """
    cases = writes.groupBy("case_id").agg(F.max_by("tags", "ingest_seq").alias("tags"), F.min("ingest_seq").alias("first_seq"),
                                          F.max("has_pii").alias("has_pii"))
    entries = F.concat(F.array(F.lit("total:")), F.when(F.col("has_pii"), F.array(F.lit("pii:"))).otherwise(F.array()),
                       F.transform("tags", lambda t: F.concat(F.lit("tag:"), t)))
    labelled = cases.select("first_seq", F.posexplode(entries).alias("pos", "label")).groupBy("label").agg(
        F.count("*").alias("n"), F.min(F.struct("first_seq", "pos")).alias("first"))
    listed = F.sort_array(F.collect_list(F.when(F.col("label").startswith("tag:"), F.struct(
        (-F.col("n")).alias("order"), "first", F.substr("label", F.lit(5)).alias("tag"), "n"))))

    def total(label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label") == label, F.col("n"))), F.lit(0).cast("long"))

    return labelled.agg(
        total("total:").alias("total_cases"), total("pii:").alias("cases_with_pii"),
        F.transform(F.slice(listed, 1, TOP_TAGS), lambda r: F.struct(r["tag"].alias("tag"), r["n"].alias("count"))).alias("top_tags"),
        F.lit(data_size).cast("long").alias("data_size"))


def stats(cases: DataFrame, vault_history: DataFrame, data_size: int = 0) -> DataFrame:
    """One row: total cases, cases with sensitive data, top tags, bytes stored.

    Each figure arrives as a few labelled rows, so the parts meet in one small final aggregate.
    """
    def part(df: DataFrame, **columns) -> DataFrame:
        types = {"total": "long", "pii": "long", "tag": "string", "count": "long",
                 "first": "struct<first_seq:bigint,pos:int>"}
        return df.select(*[columns.get(name, F.lit(None)).cast(t).alias(name) for name, t in types.items()])

    rows = (part(cases.agg(F.count("*").alias("n")), total=F.col("n"))
            .unionByName(part(count_cases_with_pii(vault_history), pii=F.col("cases_with_pii")))
            .unionByName(part(tag_counts(cases).orderBy(F.desc("count"), "first").limit(TOP_TAGS),
                              tag=F.col("tag"), count=F.col("count"), first=F.col("first"))))
    listed = F.sort_array(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct(
        (-F.col("count")).alias("order"), F.col("first"), F.col("tag"), F.col("count")))))
    return rows.agg(
        F.max("total").alias("total_cases"), F.max("pii").alias("cases_with_pii"),
        F.transform(listed, lambda r: F.struct(r["tag"].alias("tag"), r["count"].alias("count"))).alias("top_tags"),
        F.lit(data_size).cast("long").alias("data_size"))
