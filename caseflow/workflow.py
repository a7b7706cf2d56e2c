"""Adding and exporting under a policy: the profile's flags decide what runs besides the core operators."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .operators import governance, parse
from .policy import PolicyConfig, PolicyViolation
from .session import staged
from .sources.vault import write_ingested

OUTBOUND_TEXT = ("summary", "symptoms", "environment", "key_errors", "content_preview")


@dataclass(frozen=True)
class Paths:
    """Folders of one installation."""

    store: str
    vault: str
    audit: str


def add_cases(raw: DataFrame, paths: Paths, keys: DataFrame, key_id: str, policy: PolicyConfig, batch: str | None = None,
              **options) -> None:
    """Ingest raw cases: redacted rows to the store, originals to the vault, evidence to the audit table.

    A profile that requires redaction refuses ``fields='raw'``, which would store originals in the text fields, and rules
    that lack a category of the default pack.  Each text is processed once; the evidence is about the written rows.  A batch
    that failed is repeated under its name and leaves nothing twice.
    """
    batch = batch or uuid.uuid4().hex
    if policy.require_redaction:
        if options.get("fields", "redacted") != "redacted":
            raise PolicyViolation(f"profile {policy.profile!r} stores redacted fields only")
        missing = {r.category for r in R.PII_RULES} - {r.category for r in options.get("rules", R.PII_RULES)}
        if missing:
            raise PolicyViolation(f"profile {policy.profile!r} requires redaction, rules are missing for {sorted(missing)}")
    written = write_ingested(parse.ingest(raw, **options), paths.store, paths.vault, keys, key_id, batch)
    if policy.audit_log:
        operation = governance.Operation("add", policy.profile)
        governance.write_audit(governance.audit_rows(written, operation), paths.audit, batch)


def outbound_text(contexts: DataFrame) -> DataFrame:
    """All free text of a context as one string per case."""
    lists = {"symptoms", "key_errors"}
    parts = [F.map_values("environment") if c == "environment" else F.col(c) for c in OUTBOUND_TEXT]
    joined = [F.array_join(p, "\n") if c == "environment" or c in lists else p for c, p in zip(OUTBOUND_TEXT, parts)]
    return contexts.select("case_id", F.concat_ws("\n", *joined).alias("content_redacted"))


def export_contexts(contexts: DataFrame, path: str, paths: Paths, policy: PolicyConfig,
                    rules=R.PII_RULES, batch: str | None = None) -> None:
    """Write context rows as JSON for a tool outside.

    With ``outbound_scrub`` nothing is written if any sensitive pattern still matches; with ``audit_log`` every exported
    case leaves an evidence row.
    """
    batch = batch or uuid.uuid4().hex
    # What is checked is what is written: contexts are computed once.
    contexts = staged(contexts, "outbound")
    outbound = outbound_text(contexts)
    if policy.outbound_scrub:
        governance.assert_no_pii(outbound, rules=rules)
    contexts.write.mode("overwrite").json(path)
    if policy.audit_log:
        evidence = outbound.select("*", F.lit(None).cast("bigint").alias("ingest_seq"), F.lit(0).alias("tokens"))
        operation = governance.Operation("export", policy.profile)
        governance.write_audit(governance.audit_rows(evidence, operation), paths.audit, batch)

