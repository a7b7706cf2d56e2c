"""Compact redacted contexts for downstream tools, and their text renderings."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import SPACE, iso_instant, once, shorten
from ..policy import PolicyConfig, PolicyViolation
from .cases import get_cases, latest, with_mappings
from .redact import rehydrated

CONTEXT_COLUMNS = ("case_id", "summary", "symptoms", "environment", "key_errors", "tags", "content_preview")
CONTEXT_TYPE = "support_cases"


def context_columns(always_ellipsis: bool = False) -> list[Column]:
    return [
        F.col("case_id"),
        F.col("summary"),
        F.slice("symptoms", 1, R.CONTEXT_SYMPTOMS).alias("symptoms"),
        F.col("environment"),
        F.slice("error_patterns", 1, R.CONTEXT_ERRORS).alias("key_errors"),
        F.col("tags"),
        shorten(F.col("content_redacted"), R.PREVIEW_CHARS, always_ellipsis).alias("content_preview"),
    ]


def to_case_context(cases: DataFrame, always_ellipsis: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The seven-field compact row of a case, after the columns in ``keep``."""
    return cases.select(*keep, *context_columns(always_ellipsis))


def current_contexts(history: DataFrame) -> DataFrame:
    """The context of every current case (with ``first_seq``), from the append-only store.

    Contexts are cut out first and versions resolved afterwards, so the shuffle carries no case texts.
    """
    return latest(to_case_context(history, keep=["ingest_seq"]))


def requests(cases: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A list of ids as a table that remembers the order: (pos, case_id)."""
    # An Arrow table reaches the planner with its size, so the join strategy follows from it.
    table = pa.table({"pos": pa.array(range(len(ids)), pa.int64()), "case_id": pa.array(list(ids), pa.string())})
    return cases.sparkSession.createDataFrame(table)


def export_rows(contexts: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """One context per request in request order, repeats kept, unknown ids left out.

    ``contexts`` comes from ``to_case_context`` or ``current_contexts``; ``ids`` is a list or a table (pos, case_id) of
    any size.  It is joined by key, and whether it is small enough to broadcast is decided from its size.
    """
    wanted = ids if isinstance(ids, DataFrame) else requests(contexts, ids)
    return wanted.join(contexts, "case_id").select("pos", *CONTEXT_COLUMNS)


def context_pack(rows: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Fold ordered context rows (``pos`` first) into one document row.

    The document is a single value, for a list of ids or a top-k search: more than ``MOST_IN_DOCUMENT`` rows are an error.
    ``context_documents`` writes a table of any size in parallel.
    """
    rows = _bounded(rows)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*CONTEXT_COLUMNS).alias("context"))))
    return (rows.withColumn("environment", F.map_entries("environment"))
            .agg(_checked(ordered).alias("_rows"))
            .select(F.lit(CONTEXT_TYPE).alias("context_type"),
                    F.size("_rows").cast("long").alias("total_cases"),
                    iso_instant(F.current_timestamp() if generated_at is None else generated_at).alias("generated_at"),
                    F.transform("_rows", _context_of).alias("cases")))


def _context_of(row: Column) -> Column:
    context = row["context"]
    fields = [F.map_from_entries(context[c]).alias(c) if c == "environment" else context[c].alias(c)
              for c in CONTEXT_COLUMNS]
    return F.struct(*fields)


def export_context(cases: DataFrame, ids: Sequence[str], generated_at: Column | None = None) -> DataFrame:
    return context_pack(export_rows(to_case_context(cases), ids), generated_at)


def search_rows(found: DataFrame) -> DataFrame:
    """Ordered context rows of a ``search(..., with_context=True)`` result."""
    return found.select(F.struct(-F.col("score"), "first_seq").alias("pos"), *CONTEXT_COLUMNS)


MOST_IN_DOCUMENT = 10_000


def _bounded(rows: DataFrame) -> DataFrame:
    """No more rows than ``_checked`` needs to see."""
    return rows.limit(MOST_IN_DOCUMENT + 1)


def _checked(document: Column) -> Column:
    """An aggregate over ``_bounded`` rows, or an error if they do not fit one document; the input runs once."""
    message = f"more than {MOST_IN_DOCUMENT} contexts do not make one document, use context_documents"
    return F.when(F.count("*") > MOST_IN_DOCUMENT, F.raise_error(F.lit(message))).otherwise(document)


def context_documents(rows: DataFrame) -> DataFrame:
    """One JSON document per context row (pos, json): the form for tables, without a common document."""
    return rows.select("pos", F.to_json(F.struct(F.lit(CONTEXT_TYPE).alias("context_type"), *CONTEXT_COLUMNS)).alias("json"))


def _joined(rows: DataFrame, text: Column, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), text.alias("text"))))
    return F.array_join(F.transform(ordered, lambda r: r["text"]), separator)


def render_search(rows: DataFrame, query: str) -> DataFrame:
    """Search results as one text listing."""
    rows = _bounded(rows)
    text = F.concat(
        F.lit("**"), F.col("case_id"), F.lit("**: "), F.col("summary"),
        F.lit("\nTags: "), F.array_join("tags", ", "),
        F.lit("\nKey symptoms: "), F.array_join(F.slice("symptoms", 1, R.LISTED_SYMPTOMS), "; "), F.lit("\n"))
    head = F.concat(F.lit("Found "), F.count("*").cast("string"), F.lit(f' similar cases for: "{query}"\n\n'))
    return rows.agg(_checked(F.concat(head, _joined(rows, text, "\n"))).alias("text"))


def render_context(rows: DataFrame) -> DataFrame:
    """Contexts as one markdown text."""
    rows = _bounded(rows)
    environment = F.array_join(F.transform(
        F.map_entries("environment"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    text = F.concat(
        F.lit("## Case "), F.col("case_id"), F.lit("\n**Summary**: "), F.col("summary"),
        F.lit("\n**Environment**: "), environment,
        F.lit("\n**Key Errors**: "), F.array_join("key_errors", "; "),
        F.lit("\n**Tags**: "), F.array_join("tags", ", "),
        F.lit("\n**Content Preview**: "), F.col("content_preview"), F.lit("\n"))
    return rows.agg(_checked(F.concat(F.lit("**Support Case Context for Analysis:**\n\n"),
                                      _joined(rows, text, "\n---\n\n"))).alias("text"))


def chunk_context(df: DataFrame, text: str = "content_redacted", size: int = R.CHUNK_WORDS[0]) -> DataFrame:
    """Each text in chunks of ``size`` words, as rows (chunk, chunk_text) beside the other columns.

    A chunk repeats the last words of the one before: a tenth of the size, but no fewer than ``CHUNK_OVERLAP``.  A text
    without words has no chunk.
    """
    low, high = R.CHUNK_WORDS
    if not low <= size <= high:
        raise ValueError(f"chunks have {low} to {high} words, not {size}")
    overlap = max(size // 10, R.CHUNK_OVERLAP)
    words = F.array_remove(F.split(F.col(text), f"[{SPACE}]+", -1), "")
    counted = once(df, df.columns, _words=words)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    chunks = F.transform(starts, lambda at: F.array_join(F.slice("_words", at + 1, size), " "))
    return counted.filter(F.size("_words") > 0).select(*df.columns, F.posexplode(chunks).alias("chunk", "chunk_text"))


def get_full(cases: DataFrame, vault: DataFrame, ids: Sequence[str] | DataFrame, policy: PolicyConfig,
             context: bool = False) -> DataFrame:
    """Cases with ``content_full``, their original text; NULL for a case without mappings.

    Where an input already held token-like text (``token_collision``) the restored text may differ from it.

    ``context`` wins and returns contexts.  If the policy forbids restoring and any requested case has mappings, nothing
    is returned.  The result holds originals: it is lazy and never written here.
    """
    wanted = get_cases(cases, ids)
    if context:
        return to_case_context(wanted)
    mapped = vault.filter(F.size("mappings") > 0)
    if not policy.allow_full_rehydration:
        if not get_cases(mapped, ids).select("case_id").limit(1).isEmpty():
            raise PolicyViolation(f"full rehydration is not permitted under profile {policy.profile!r}")
    full = F.when(F.size("mappings") > 0, rehydrated(F.col("content_redacted"), F.col("mappings"), newest_first=True))
    return with_mappings(wanted, mapped).withColumn("content_full", full).drop("mappings")
