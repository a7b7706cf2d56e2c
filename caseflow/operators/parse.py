"""Raw case text to case rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import fields as X
from ..functions.text import is_blank, once, trimmed_lines, word_count
from .logs import compress_logs
from .redact import redact

CASE_COLUMNS = (
    "case_id", "summary", "symptoms", "environment", "error_patterns", "tags", "content_redacted", "word_count",
    "created_at", "updated_at", "ingest_seq",
)
VAULT_COLUMNS = ("case_id", "ingest_seq", "mappings")


def reject_blank(df: DataFrame, text: str = "content") -> DataFrame:
    return df.filter(~is_blank(F.col(text)))


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def case_id(df: DataFrame, text: str = "content", detected_first: bool = False, lowered: Column | None = None) -> Column:
    """Given id, else the id found in the text, else a stable generated one.

    ``detected_first`` prefers the id in the text over the given one, as the older variant does.
    """
    given = _column(df, "given_case_id", F.lit(None).cast("string"))
    found = X.detected_case_id(F.col(text), lowered=lowered)
    first, second = (found, given) if detected_first else (given, found)
    source = _column(df, "source", F.lit(""))
    return F.coalesce(first, second, X.fallback_case_id(source, F.col("ingest_seq"), F.col(text)))


def parse_case(
    df: DataFrame,
    text: str = "content",
    read_from: str | None = None,
    tag_rules: Sequence[R.Rule] = R.TAG_RULES,
    detected_first: bool = False,
    with_discussion: bool = False,
) -> DataFrame:
    """Add the case columns to ``df``, one row per text and without a shuffle.

    ``read_from`` names the column from which summary, symptoms, environment and error lines are taken; it defaults to
    the raw text.  Id, tags and word count always come from the raw text: they hold no free text.
    """
    added = {"case_id", "summary", "symptoms", "environment", "error_patterns", "tags", "word_count", "created_at",
             "updated_at", "discussion"}
    kept = [c for c in df.columns if c not in added]
    raw, source = F.col(text), F.col(read_from or text)
    now = _column(df, "ts", F.current_timestamp())
    lowered, lowered_source = F.col("_lowered"), F.col("_lowered_source" if read_from else "_lowered")
    lined = df.withColumns({"_lined": trimmed_lines(source), "_lowered": F.lower(raw)} | ({"_lowered_source": F.lower(source)} if read_from else {}))
    computed = {
        "case_id": case_id(df, text, detected_first, lowered),
        "summary": X.summary(F.col("_lined")),
        "symptoms": X.symptoms(source, lowered=lowered_source),
        "environment": X.environment(source, lowered=lowered_source),
        "error_patterns": X.error_patterns(F.col("_lined")),
        "tags": X.tags(raw, tag_rules, lowered),
        "word_count": word_count(raw),
        "created_at": now,
        "updated_at": now,
    }
    if with_discussion:
        computed["discussion"] = X.discussion(source)
    return once(lined, kept, **computed)


def ingest(
    raw: DataFrame,
    fields: str = "redacted",
    rules: Sequence[R.PiiRule] = R.PII_RULES,
    compress: bool = False,
    **parse_options,
) -> DataFrame:
    """Case rows with redacted content and the mappings that restore it.

    ``fields='redacted'`` takes the free-text fields from redacted text, so that no original is stored outside the vault;
    ``fields='raw'`` takes them from the input.  ``compress`` first collapses repeated log lines.
    """
    if fields not in ("redacted", "raw"):
        raise ValueError(f"fields must be 'redacted' or 'raw', not {fields!r}")
    df = reject_blank(raw)
    if compress:
        df = compress_logs(df, into="content")
    df = redact(df, rules=rules)
    return parse_case(df, read_from="content_redacted" if fields == "redacted" else None, **parse_options)


def cases_of(ingested: DataFrame) -> DataFrame:
    """The case rows of an ingest, without raw text and without mappings."""
    extra = [c for c in ("discussion", "token_collision", "content_md5", "first_seq") if c in ingested.columns]
    return ingested.select(*CASE_COLUMNS, *extra)


def vault_of(ingested: DataFrame) -> DataFrame:
    """The mappings of an ingest, one row per case write that had any."""
    return ingested.filter(F.size("mappings") > 0).select(*VAULT_COLUMNS)


def case_counts(cases: DataFrame) -> DataFrame:
    """What an add reports: numbers of symptoms and error lines, and of tokens where mappings are present."""
    counts = [F.size("symptoms").alias("n_symptoms"), F.size("error_patterns").alias("n_errors")]
    if "mappings" in cases.columns:
        counts.append(F.coalesce(F.size("mappings"), F.lit(0)).alias("n_tokens"))
    return cases.select("case_id", "ingest_seq", *counts)
