"""One registered query per operator: (spark, folder of tables) -> DataFrame over the whole tables.

Results are flat, so that any SQL engine can check them: arrays are joined with ``|`` and maps become ``key=value`` lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .. import workflow
from ..functions import crypto
from ..functions import fields as X
from ..functions.text import lines, trimmed_lines, word_count
from ..operators import cases as C
from ..operators import context as K
from ..operators import governance, grams, logs, parse, recall, redact, search, stats
from ..policy import STRICT, TRUSTED, CategoryRule, policy
from ..session import shared_folder, spread, staged
from ..sources.files import context_json as context_document
from ..sources.files import read_case_files, stream_case_files
from ..sources.store import export_case_store_json, read_case_store, read_case_store_json, store_size, to_store_json, write_case_store
from ..sources.vault import merge, read_sealed, read_vault, rotate, transfer, unseal, write_ingested, write_vault
from ..streaming import rollups, stateful
from ..streaming.monitor import Target, dedupe_seen, monitor
from .corpus import COLUMNS, raw_cases, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEARCH_PHRASE = "timeout"
BATCH_PHRASES = ("timeout", "linux", "Socket", "azure storage", "telegraf", "zyxwvuts", "[EMAIL_1]", "the ")
BATCH_LIMIT = 7
#: Phrases looked up in the index: common, rare and absent ones, and some under three characters.
INDEX_PHRASES = (*BATCH_PHRASES, "a", "", "10", *(f"1.{n}" for n in range(40)), *(f"vm-prod-{n}" for n in range(10)),
                 *(f"work item {n}" for n in range(10)), *(f"azure storage {w}" for w in ("latency", "Latency issue", "queue")))

DEMO_SECRET = "00112233445566778899aabbccddeeff"
DEMO_KEYS = {"team": "0f" * 32, "other": "a5" * 32}
DEMO_POLICY = {
    "EMAIL": CategoryRule(),
    "SUBSCRIPTION_ID": CategoryRule(redact="hash", reversible=False, export="deny"),
    "GUID": CategoryRule(reversible=False),
    "PHONE": CategoryRule(redact="none"),
    "VM_NAME": CategoryRule(export="deny"),
}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(values: Column | str) -> Column:
    return F.array_join(values, "|")


def flat_map(entries: Column | str) -> Column:
    return joined(F.transform(F.sort_array(F.map_entries(entries)),
                              lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def flat_mappings(mappings: Column | str) -> Column:
    return joined(F.transform(mappings, lambda e: F.concat(e["token"], F.lit("="), e["original"])))


def flat_discussion(entries: Column | str) -> Column:
    return joined(F.transform(entries, lambda e: F.concat(e["author"], F.lit("@"), e["timestamp"])))


def ingested(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return parse.ingest(raw_cases(spark, sf_dir), **options)


def case_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.cases_of(ingested(spark, sf_dir))


def vault_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings without the parsed case fields: only the id is read besides the redaction."""
    raw = raw_cases(spark, sf_dir)
    named = raw.withColumn("case_id", parse.case_id(raw))
    return redact.redact(named).filter(F.size("mappings") > 0).select(*parse.VAULT_COLUMNS)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current cases; which writes are current is known before anything is redacted."""
    return parse.cases_of(ingest_named(C.current_writes(named(spark, sf_dir))))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = parse.reject_blank(raw_cases(spark, sf_dir))
    return raw.withColumn("case_id", parse.case_id(raw))


def ingest_named(writes: DataFrame) -> DataFrame:
    return parse.ingest(writes.withColumn("given_case_id", F.col("case_id")).drop("case_id"))


# Extraction ------------------------------------------------------------------------------------------------------


def _field(spark: SparkSession, sf_dir: str, name: str, value: Callable[[Column], Column]) -> DataFrame:
    return raw_cases(spark, sf_dir).select("ingest_seq", value(F.col("content")).alias(name))


@query
def parse_lines(spark, sf_dir):
    return _field(spark, sf_dir, "lines", lambda c: joined(lines(c)))


@query
def parse_summary(spark, sf_dir):
    return _field(spark, sf_dir, "summary", lambda c: X.summary(trimmed_lines(c)))


@query
def parse_case_id(spark, sf_dir):
    raw = raw_cases(spark, sf_dir)
    return raw.select("ingest_seq", parse.case_id(raw).alias("case_id"))


@query
def parse_case_id_legacy(spark, sf_dir):
    """The id found in the text wins over the given one."""
    raw = raw_cases(spark, sf_dir)
    return raw.select("ingest_seq", parse.case_id(raw, detected_first=True).alias("case_id"))


@query
def parse_environment(spark, sf_dir):
    return _field(spark, sf_dir, "environment", lambda c: flat_map(X.environment(c)))


@query
def parse_symptoms(spark, sf_dir):
    return _field(spark, sf_dir, "symptoms", lambda c: joined(X.symptoms(c)))


@query
def parse_errors(spark, sf_dir):
    return _field(spark, sf_dir, "error_patterns", lambda c: joined(X.error_patterns(trimmed_lines(c))))


@query
def parse_tags(spark, sf_dir):
    return _field(spark, sf_dir, "tags", lambda c: joined(X.tags(c)))


@query
def parse_tags_legacy(spark, sf_dir):
    return _field(spark, sf_dir, "tags", lambda c: joined(X.tags(c, R.TAG_RULES_LEGACY)))


@query
def parse_word_count(spark, sf_dir):
    return _field(spark, sf_dir, "word_count", lambda c: word_count(c).cast("long"))


@query
def parse_discussion(spark, sf_dir):
    return _field(spark, sf_dir, "discussion", lambda c: flat_discussion(X.discussion(c)))


@query
def detect_case_ids(spark, sf_dir):
    return _field(spark, sf_dir, "case_ids", lambda c: joined(X.detect_case_ids(c)))


@query
def valid_content(spark, sf_dir):
    """Conversation turns that count as case content; the speaker's role is part of the text."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    said = F.concat("role", F.lit(": "), "text")
    return turns.filter(X.is_case_content(said)).select("conv_id", "turn")


@query
def content_hash(spark, sf_dir):
    return _field(spark, sf_dir, "content_md5", X.content_hash)


@query
def reject_blank(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return parse.reject_blank(turns).groupBy("conv_id").agg(F.count("*").alias("turns"))


def _flat_case(cases: DataFrame, *more: Column) -> DataFrame:
    return cases.select(
        "ingest_seq", "case_id", "summary", joined("symptoms").alias("symptoms"),
        flat_map("environment").alias("environment"), joined("error_patterns").alias("error_patterns"),
        joined("tags").alias("tags"), F.col("word_count").cast("long").alias("word_count"), *more)


@query
def parse_case(spark, sf_dir):
    """Fields taken from the raw text."""
    return _flat_case(parse.parse_case(raw_cases(spark, sf_dir)))


@query
def ingest_cases(spark, sf_dir):
    """Fields taken from the redacted text."""
    return _flat_case(ingested(spark, sf_dir))


@query
def ingest_legacy(spark, sf_dir):
    """The older composition: compress, parse with the older rules, redact with both older passes."""
    done = ingested(spark, sf_dir, compress=True, fields="raw", rules=R.PII_RULES_LEGACY + R.CONTEXT_RULES,
                    tag_rules=R.TAG_RULES_LEGACY, detected_first=True, with_discussion=True)
    return _flat_case(done, flat_discussion("discussion").alias("discussion"), F.col("content_redacted"),
                      flat_mappings("mappings").alias("mappings"))


@query
def case_counts(spark, sf_dir):
    counts = parse.case_counts(ingested(spark, sf_dir))
    return counts.select("case_id", "ingest_seq", *[F.col(c).cast("long").alias(c)
                                                    for c in ("n_symptoms", "n_errors", "n_tokens")])


# Log compression -------------------------------------------------------------------------------------------------


@query
def compress_logs(spark, sf_dir):
    return logs.compress_logs(raw_cases(spark, sf_dir)).select("ingest_seq", "content_compressed")


@query
def log_pattern_counts(spark, sf_dir):
    raw = raw_cases(spark, sf_dir)
    return logs.log_pattern_counts(raw.withColumn("case_id", parse.case_id(raw)))


# Redaction -------------------------------------------------------------------------------------------------------


@query
def redact_text(spark, sf_dir):
    return redact.redact(raw_cases(spark, sf_dir)).select("ingest_seq", "content_redacted", "token_collision")


@query
def redact_mappings(spark, sf_dir):
    return redact.redact(raw_cases(spark, sf_dir)).select(
        "ingest_seq", redact.pii_token_count(F.col("mappings")).cast("long").alias("tokens"),
        flat_mappings("mappings").alias("mappings"))


@query
def redact_legacy_pack(spark, sf_dir):
    done = redact.redact(raw_cases(spark, sf_dir), rules=R.PII_RULES_LEGACY)
    return done.select("ingest_seq", "content_redacted", flat_mappings("mappings").alias("mappings"))


@query
def redact_contextual(spark, sf_dir):
    done = redact.redact_contextual(raw_cases(spark, sf_dir))
    return done.select("ingest_seq", "content_redacted", flat_mappings("mappings").alias("mappings"))


@query
def redact_legacy(spark, sf_dir):
    done = redact.redact_legacy(raw_cases(spark, sf_dir))
    return done.select("ingest_seq", "content_redacted", flat_mappings("mappings").alias("mappings"))


@query
def redact_extended_pack(spark, sf_dir):
    done = redact.redact(raw_cases(spark, sf_dir), rules=R.PII_RULES_EXTENDED)
    return done.select("ingest_seq", "content_redacted", flat_mappings("mappings").alias("mappings"))


def _restored(spark: SparkSession, sf_dir: str, rules) -> DataFrame:
    done = redact.redact(raw_cases(spark, sf_dir), rules=rules).filter(~F.col("token_collision"))
    restored = redact.rehydrated(F.col("content_redacted"), F.col("mappings"), newest_first=True)
    return done.select("ingest_seq", restored.alias("content"))


@query
def rehydrate_legacy(spark, sf_dir):
    """The same with the older packs, whose later rules can swallow tokens."""
    return _restored(spark, sf_dir, R.PII_RULES_LEGACY + R.CONTEXT_RULES)


@query
def rehydrate_extended(spark, sf_dir):
    return _restored(spark, sf_dir, R.PII_RULES_EXTENDED)


@query
def pii_inventory(spark, sf_dir):
    return redact.pii_inventory(redact.redact(raw_cases(spark, sf_dir)))


@query
def pii_by_case(spark, sf_dir):
    return redact.pii_inventory(vault_history(spark, sf_dir), by=["case_id"])


@query
def rehydrate_roundtrip(spark, sf_dir):
    """Restored text of every case whose input held no token-like text."""
    done = redact.redact(raw_cases(spark, sf_dir)).filter(~F.col("token_collision"))
    restored = redact.rehydrated(F.col("content_redacted"), F.col("mappings"))
    return done.select("ingest_seq", restored.alias("content"))


# Versions, look-ups, joins ---------------------------------------------------------------------------------------


@query
def current_cases(spark, sf_dir):
    return current(spark, sf_dir).select("case_id", "ingest_seq", "first_seq", "summary", "content_redacted")


@query
def current_vault(spark, sf_dir):
    return C.current_vault(vault_history(spark, sf_dir)).select(
        "case_id", "ingest_seq", flat_mappings("mappings").alias("mappings"))


def _ids_and_vault(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = raw_cases(spark, sf_dir)
    ids = raw.select(parse.case_id(raw).alias("case_id"), "ingest_seq")
    return C.latest(ids), vault_history(spark, sf_dir)


@query
def cases_without_pii(spark, sf_dir):
    return C.cases_without_pii(*_ids_and_vault(spark, sf_dir)).select("case_id", "first_seq")


@query
def cases_with_pii(spark, sf_dir):
    return C.cases_with_pii(*_ids_and_vault(spark, sf_dir)).select("case_id", "first_seq")


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of requests: the case a label refers to; some ids are unknown and some asked for twice."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("ICM-"), (F.lit(600000000) + F.col("doc_id") - F.col("doc_id") % 2).cast("string"))
        .alias("case_id"))


def _requested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested writes of the requested cases: ids are matched on the raw rows, so only those texts are redacted."""
    return ingest_named(C.get_cases(named(spark, sf_dir), _requested(spark, sf_dir).select("case_id")))


@query
def get_cases(spark, sf_dir):
    wanted = C.get_cases(named(spark, sf_dir), _requested(spark, sf_dir).select("case_id"))
    cases = ingest_named(C.current_writes(wanted))
    return cases.select("case_id", "ingest_seq", "summary", joined("tags").alias("tags"))


def _written(done: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """An ingest through the store and the sealed vault: case history and mappings as tables."""
    spark = done.sparkSession
    keys, path = crypto.key_table(spark, **DEMO_KEYS), shared_folder(spark, name)
    write_ingested(done, f"{path}/store", f"{path}/vault", keys, "team")
    return read_case_store(spark, f"{path}/store"), read_vault(spark, f"{path}/vault", keys)


@query
def case_with_vault(spark, sf_dir):
    """Current cases with the mappings of the same write."""
    history, vault = _written(ingested(spark, sf_dir), "case_with_vault")
    rows = C.current_cases(history, columns=["summary"])
    return C.with_mappings(rows, vault).select(
        "case_id", "ingest_seq", "summary", flat_mappings("mappings").alias("mappings"))


@query
def get_full(spark, sf_dir):
    """Restored current cases under the trusted profile, for a table of requests."""
    history, vault = _written(_requested_history(spark, sf_dir), "get_full")
    ids = _requested(spark, sf_dir).select("case_id")
    return K.get_full(C.current_cases(history), vault, ids, TRUSTED).select("case_id", "ingest_seq", "content_full")


@query
def strict_gate(spark, sf_dir):
    """Under the strict profile, requests for cases without sensitive data pass; with any other one nothing would."""
    history, vault = _written(_requested_history(spark, sf_dir), "strict_gate")
    ids = C.cases_without_pii(_requested(spark, sf_dir), vault).select("case_id")
    return K.get_full(C.current_cases(history), vault, ids, STRICT).select("case_id", "ingest_seq", "content_full")


@query
def content_dedupe(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_seq"), "text")
    return C.first_copies(texts, text="text").select("ingest_seq", "content_md5", "copies")


@query
def changed_only(spark, sf_dir):
    """Per user, the events whose type differs from the one before."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return C.changed_only(events, text="event_type", source="user_id", order="event_id",
                          slice_length="1 day").select("event_id", "user_id", "event_type")


# Search ----------------------------------------------------------------------------------------------------------


def _flat_hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "case_id", F.col("score").cast("long").alias("score"),
                        joined("matches").alias("matches"), "summary", joined("tags").alias("tags"), "first_seq")


@query
def search_scores(spark, sf_dir):
    """Every current case with its score, hit or not."""
    return _flat_hits(search.scored(current(spark, sf_dir), SEARCH_PHRASE))


@query
def search_topk(spark, sf_dir):
    return _flat_hits(search.search(current(spark, sf_dir), SEARCH_PHRASE))


@query
def search_accumulate(spark, sf_dir):
    return _flat_hits(search.search(current(spark, sf_dir), "socket", accumulate=True))


@query
def search_history(spark, sf_dir):
    return _flat_hits(search.search_history(case_history(spark, sf_dir), SEARCH_PHRASE))


@query
def search_batch(spark, sf_dir):
    found = search.search_batch(current(spark, sf_dir), BATCH_PHRASES, limit=BATCH_LIMIT)
    return _flat_hits(found, F.col("query_no").cast("long").alias("query_no"), "query",
                      F.col("rank").cast("long").alias("rank"))


@query
def search_indexed(spark, sf_dir):
    """Many phrases through the trigram index of a store that was written in two batches."""
    store = f"{shared_folder(spark, 'search_indexed')}/store"
    batch = F.pmod(F.col("ingest_seq"), F.lit(2)) == 0
    history = staged(case_history(spark, sf_dir), "history")
    for name, some in (("even", batch), ("others", batch.isNull() | ~batch)):
        write_case_store(history.filter(some), f"{store}/cases", name)
        grams.index_writes(history.filter(some), f"{store}/index", name)
    cases = C.current_cases(read_case_store(spark, f"{store}/cases"))
    found = grams.search_indexed(cases, f"{store}/index", INDEX_PHRASES, limit=BATCH_LIMIT)
    return _flat_hits(found, F.col("query_no").cast("long").alias("query_no"), "query",
                      F.col("rank").cast("long").alias("rank"))


# Context ---------------------------------------------------------------------------------------------------------


def _flat_context(rows: DataFrame) -> DataFrame:
    return rows.select("pos", "case_id", "summary", joined("symptoms").alias("symptoms"),
                       flat_map("environment").alias("environment"), joined("key_errors").alias("key_errors"),
                       joined("tags").alias("tags"), "content_preview")


def _found_rows(spark: SparkSession, sf_dir: str, phrase: str = SEARCH_PHRASE, limit: int = 10) -> DataFrame:
    return K.search_rows(search.search_history(case_history(spark, sf_dir), phrase, limit, with_context=True))


@query
def case_context(spark, sf_dir):
    return _flat_context(K.current_contexts(case_history(spark, sf_dir)).withColumnRenamed("first_seq", "pos"))


@query
def case_context_legacy(spark, sf_dir):
    """The older preview ends in an ellipsis whatever its length."""
    narrow = K.to_case_context(case_history(spark, sf_dir), always_ellipsis=True, keep=["ingest_seq"])
    return C.latest(narrow).select("case_id", "content_preview")


@query
def context_json(spark, sf_dir):
    """Fields of the JSON document of a search's contexts."""
    document = context_document(K.context_pack(_found_rows(spark, sf_dir)))
    paths = {"context_type": "$.context_type", "total_cases": "$.total_cases", "first_case": "$.cases[0].case_id",
             "first_summary": "$.cases[0].summary"}
    return document.select(*[F.get_json_object("json", path).alias(name) for name, path in paths.items()])


@query
def export_context(spark, sf_dir):
    contexts = K.current_contexts(parse.cases_of(_requested_history(spark, sf_dir)))
    return _flat_context(K.export_rows(contexts, _requested(spark, sf_dir)))


@query
def context_pack(spark, sf_dir):
    pack = K.context_pack(_found_rows(spark, sf_dir), F.timestamp_seconds(F.lit(1704067200)))
    return pack.select("context_type", "total_cases", "generated_at",
                       joined(F.transform("cases", lambda c: c["case_id"])).alias("case_ids"),
                       joined(F.transform("cases", lambda c: c["content_preview"])).alias("previews"))


@query
def render_search(spark, sf_dir):
    return K.render_search(_found_rows(spark, sf_dir, limit=5), SEARCH_PHRASE)


@query
def render_context(spark, sf_dir):
    return K.render_context(_found_rows(spark, sf_dir, limit=5))


# Statistics ------------------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current cases with only what statistics need: no redaction runs."""
    raw = raw_cases(spark, sf_dir)
    rows = raw.select(parse.case_id(raw).alias("case_id"), "ingest_seq", X.tags(F.col("content")).alias("tags"))
    return C.latest(rows)


@query
def top_tags(spark, sf_dir):
    return stats.top_tags(_tagged(spark, sf_dir))


@query
def store_stats(spark, sf_dir):
    done = redact.redact(named(spark, sf_dir))
    row = stats.stats_of_writes(done.select("case_id", "ingest_seq", X.tags(F.col("content")).alias("tags"),
                                            (F.size("mappings") > 0).alias("has_pii")))
    return row.select("total_cases", "cases_with_pii", joined(F.transform(
        "top_tags", lambda t: F.concat(t["tag"], F.lit("="), t["count"].cast("string")))).alias("top_tags"))


@query
def flagship(spark, sf_dir):
    """Ingest, redact, keep the current version, search, export contexts."""
    return _flat_context(_found_rows(spark, sf_dir).withColumn("pos", F.col("pos.first_seq")))


@query
def chunk_context(spark, sf_dir):
    chunks = K.chunk_context(redact.redact(raw_cases(spark, sf_dir)).select("ingest_seq", "content_redacted"))
    return chunks.select("ingest_seq", F.col("chunk").cast("long").alias("chunk"), "chunk_text")


# Governance ------------------------------------------------------------------------------------------------------

@query
def pseudonymize(spark, sf_dir):
    pads = governance.pad_table(spark, team=DEMO_SECRET)
    return governance.pseudonymize(raw_cases(spark, sf_dir), pads, "team").select("ingest_seq", "content_redacted")


@query
def policy_rules(spark, sf_dir):
    pads = governance.pad_table(spark, team=DEMO_SECRET)
    done = governance.apply_policy(raw_cases(spark, sf_dir), DEMO_POLICY, pads, "team")
    return done.select("ingest_seq", "content_redacted", flat_mappings("mappings").alias("mappings"),
                       governance.outbound_text(F.col("content_redacted"), DEMO_POLICY).alias("outbound"))


@query
def policy_check(spark, sf_dir):
    return governance.policy_check(raw_cases(spark, sf_dir),
                                   {"default": R.PII_RULES, "extended": R.PII_RULES_EXTENDED})


@query
def assert_no_pii(spark, sf_dir):
    """Rows per category in which a pattern matches, on the unredacted texts."""
    return governance.pii_matches(raw_cases(spark, sf_dir), "content")


@query
def audit_rows(spark, sf_dir):
    rows = governance.audit_rows(ingested(spark, sf_dir), governance.Operation("ingest", "strict"))
    return rows.select("case_id", "ingest_seq", "operation", "profile", F.col("tokens").cast("long").alias("tokens"),
                       "pii_free")


@query
def fingerprint(spark, sf_dir):
    rows = redact.redact(raw_cases(spark, sf_dir)).select(
        F.col("ingest_seq").cast("string").alias("case_id"), "content_redacted")
    return governance.export_mode(rows, "fingerprint").select("case_id", joined("fingerprint").alias("fingerprint"))


@query
def fingerprint_match(spark, sf_dir):
    """Classes of cases with equal fingerprints, and how many cases share four fifths of their words with them."""
    texts = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("content")), "case_id")
    prints = governance.export_mode(redact.redact(texts).select("case_id", "content_redacted"), "fingerprint")
    return recall.fingerprint_match(prints).withColumnRenamed("class_id", "first_seq")


@query
def export_summary(spark, sf_dir):
    rows = governance.export_mode(current(spark, sf_dir), "summary")
    return _flat_context(rows.withColumn("pos", F.lit(0).cast("long"))).drop("pos")


@query
def export_diagnostic(spark, sf_dir):
    rows = governance.export_mode(current(spark, sf_dir), "diagnostic")
    return rows.select("case_id", "summary", joined("tags").alias("tags"), "content_redacted")


@query
def export_full(spark, sf_dir):
    history, vault = _written(_requested_history(spark, sf_dir), "export_full")
    ids = _requested(spark, sf_dir).select("case_id")
    rows = governance.export_mode(C.current_cases(history), "full", vault, ids, TRUSTED)
    return rows.select("case_id", "content_full")


@query
def policy_flags(spark, sf_dir):
    """The profile that each document's request names, with its flags."""
    names = F.when(F.col("doc_id") % 3 == 0, "strict").otherwise("trusted").alias("profile")
    flags = spark.createDataFrame([asdict(policy(name)) for name in ("strict", "trusted")])
    asked = table(spark, sf_dir, "documents").select(names).groupBy("profile").agg(F.count("*").alias("requests"))
    return asked.join(flags, "profile").select("profile", "requests", "require_redaction", "allow_full_rehydration",
                                               "encrypt_vault", "audit_log", "outbound_scrub")


def _paths(spark: SparkSession, name: str) -> workflow.Paths:
    path = shared_folder(spark, name)
    return workflow.Paths(f"{path}/store", f"{path}/vault", f"{path}/audit")


@query
def policy_add(spark, sf_dir):
    """Adding under the strict profile: the evidence that it leaves.  The batch is written twice, as after a failure."""
    paths, keys = _paths(spark, "policy_add"), crypto.key_table(spark, **DEMO_KEYS)
    for _ in range(2):
        workflow.add_cases(raw_cases(spark, sf_dir), paths, keys, "team", STRICT, batch="first")
    audit = governance.read_audit(spark, paths.audit)
    stored = read_case_store(spark, paths.store).select("case_id", "ingest_seq", "content_redacted")
    return audit.join(stored, ["case_id", "ingest_seq"]).select(
        "case_id", "ingest_seq", "operation", "profile", F.col("tokens").cast("long").alias("tokens"), "pii_free", "content_redacted")


@query
def policy_export(spark, sf_dir):
    """Contexts written for a tool outside under the strict profile, checked and with evidence, and read back."""
    path, paths = shared_folder(spark, "policy_export"), _paths(spark, "audit")
    workflow.export_contexts(K.current_contexts(case_history(spark, sf_dir)), path, paths, STRICT)
    evidence = governance.read_audit(spark, paths.audit).select("case_id", "operation", "profile", "pii_free")
    return spark.read.schema("case_id string, summary string, content_preview string").json(path).join(evidence, "case_id")


@query
def linked_items(spark, sf_dir):
    raw = raw_cases(spark, sf_dir)
    return governance.linked_items(raw.select(parse.case_id(raw).alias("case_id"), "content"))


@query
def entities(spark, sf_dir):
    raw = raw_cases(spark, sf_dir)
    return governance.entities(raw.select(parse.case_id(raw).alias("case_id"), "content"))


# Stores and vault ------------------------------------------------------------------------------------------------


@query
def vault_roundtrip(spark, sf_dir):
    """Seal, write, read and unseal the mappings of every write."""
    keys = crypto.key_table(spark, **DEMO_KEYS)
    path = shared_folder(spark, "vault")
    write_vault(vault_history(spark, sf_dir), path, keys, "team")
    return read_vault(spark, path, keys).select("case_id", "ingest_seq", flat_mappings("mappings").alias("mappings"))


@query
def vault_transfer(spark, sf_dir):
    """Hand a vault over to another key, merge it with one's own, keep the last mappings per case."""
    keys = crypto.key_table(spark, **DEMO_KEYS)
    path = shared_folder(spark, "vault")
    write_vault(vault_history(spark, sf_dir), path, keys, "team")
    own = read_sealed(spark, path)
    both = merge(own, transfer(own, keys, "other"))
    return C.current_vault(unseal(both, keys)).select(
        "case_id", "ingest_seq", flat_mappings("mappings").alias("mappings"))


@query
def vault_rotation(spark, sf_dir):
    """The vault sealed anew under the last key of a chain; payloads that were put into another case's row are unreadable."""
    keys = crypto.key_table(spark, **DEMO_KEYS)
    path = shared_folder(spark, "vault")
    write_vault(vault_history(spark, sf_dir), path, keys, "team")
    rotated = rotate(read_sealed(spark, path), keys, ["team", "other"])
    moved = rotated.withColumn("case_id", F.concat("case_id", F.lit(" moved")))
    return unseal(rotated.unionByName(moved), keys.filter("key_id = 'other'")).select(
        "case_id", "ingest_seq", flat_mappings("mappings").alias("mappings"), "readable")


@query
def encrypt_cbc(spark, sf_dir):
    """Every text through the older cipher form and back."""
    key = crypto.key_column(crypto.key_table(spark, **DEMO_KEYS), "team")
    sealed = raw_cases(spark, sf_dir).select("ingest_seq", crypto.encrypt_cbc(F.col("content"), key).alias("payload"))
    return sealed.select("ingest_seq", crypto.decrypt_cbc(F.col("payload"), key).alias("content"))


@query
def case_store(spark, sf_dir):
    """Append all case writes to a store, read it back, resolve the current cases."""
    path = shared_folder(spark, "store")
    write_case_store(case_history(spark, sf_dir), path)
    return C.current_cases(read_case_store(spark, path)).select("case_id", "ingest_seq", "first_seq", "summary",
                                                                "content_redacted")


@query
def case_store_json(spark, sf_dir):
    """Current cases to the JSON exchange form and back."""
    path = shared_folder(spark, "json")
    export_case_store_json(current(spark, sf_dir), path)
    back = read_case_store_json(spark, path, whole_file=False)
    return back.select("case_id", "summary", joined("symptoms").alias("symptoms"),
                       flat_map("environment").alias("environment"), joined("error_patterns").alias("error_patterns"),
                       joined("tags").alias("tags"), "content_redacted",
                       F.col("word_count").cast("long").alias("word_count"))


#: JSON objects that a store is dealt to, at least, and the most documents per object: one is made by a single task.
OBJECTS, DOCS_PER_OBJECT = 16, 10_000


@query
def case_store_object(spark, sf_dir):
    """Current cases as one JSON object per file, read back in ranges."""
    path = shared_folder(spark, "object")
    entry = F.regexp_replace("value", r"(?s)^\{(.*)\}$", "$1")
    objects = max(OBJECTS, -(-table(spark, sf_dir, "documents").count() // DOCS_PER_OBJECT))
    # The exchange form of one store, indented as tools write it.
    rows = to_store_json(current(spark, sf_dir)).select(F.pmod(F.xxhash64("value"), F.lit(objects)).alias("part"), entry.alias("value"))
    whole = rows.groupBy("part").agg(F.concat(F.lit("{\n  "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n}\n")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = read_case_store_json(spark, path)
    return back.select("case_id", "summary", joined("tags").alias("tags"), "content_redacted",
                       F.col("word_count").cast("long").alias("word_count"), "readable")


#: Documents per file where texts are read from files.
DOCS_PER_FILE = 100


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files, in folders by number."""
    path = shared_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {DOCS_PER_FILE}").alias("part"), "text")
    docs.repartition("part").write.partitionBy("part").text(path)
    return f"{path}/*"


def _file_rows(cases: DataFrame) -> DataFrame:
    return cases.select(F.regexp_extract("source", r"part=(\d+)", 1).cast("long").alias("part"),
                        F.char_length("content").cast("long").alias("chars"))


@query
def case_files(spark, sf_dir):
    """Files as cases; no two share a number."""
    cases = read_case_files(spark, _text_files(spark, sf_dir))
    return _file_rows(cases.groupBy("ingest_seq").agg(F.min("source").alias("source"), F.min("content").alias("content")))


@query
def stream_files(spark, sf_dir):
    """Files as they arrive; no two share a number."""
    stream = stream_case_files(spark, _text_files(spark, sf_dir)).select("source", "ingest_seq", "content")
    with stateful.rocksdb(spark):
        cases = _run_to_table(stream, shared_folder(spark, "streamed"))
    return _file_rows(cases.groupBy("ingest_seq").agg(F.min("source").alias("source"), F.min("content").alias("content")))


@query
def data_size(spark, sf_dir):
    path = shared_folder(spark, "size")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    size = store_size(spark, path)
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents")).withColumn("bytes", F.lit(size).cast("long"))


# Streams ---------------------------------------------------------------------------------------------------------


#: Micro-batches that a table arrives in, and how far a row may be from its place where they arrive out of order.
ARRIVALS = 4
DISORDER = 1500
#: The limits of ``stream_newest``, and the kinds that an event type is split into.
NEWEST_MOST, NEWEST_KEPT, NEWEST_KINDS = 8, 4, 3


def _arrive(spark: SparkSession, still: DataFrame, order: str, run: Callable[[DataFrame], object], arrivals: int | None = None) -> None:
    """A table as a stream of several micro-batches in ``order``: ``run`` is given the stream after each part was written.

    A part is written by the tasks that read the table, and all its files are one micro-batch of a run that keeps its
    checkpoint.  Parts have about as many rows each, rows with a null in ``order`` come first, and a table without any
    other arrives at once.
    """
    path = shared_folder(spark, "arriving")
    arrivals = arrivals or ARRIVALS
    places = [k / arrivals for k in range(1, arrivals)]
    ends = still.agg(F.percentile_approx(order, places, 10_000)).first()[0] or []
    for low, high in zip([None, *ends], [*ends, None]):
        part = F.lit(True) if high is None else F.col(order) <= high
        part = part | F.col(order).isNull() if low is None else part & (F.col(order) > low)
        still.filter(part).write.mode("append").parquet(path)
        run(spark.readStream.schema(still.schema).parquet(path))


def _texts_arrive(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], object], arrivals: int | None = None) -> None:
    """The documents as arriving support texts; exact copies stay exact copies."""
    _arrive(spark, table(spark, sf_dir, "documents"), "doc_id", lambda docs: run(docs.select(
        "source", F.col("doc_id").alias("ingest_seq"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"),
        F.lit(None).cast("string").alias("given_case_id"),
        F.concat(F.lit("Support note: "), F.col("text")).alias("content"))), arrivals)


def _run_to_table(df: DataFrame, path: str) -> DataFrame:
    """Run a stream over everything that is there and return what it has written to ``path`` so far."""
    (df.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start(f"{path}/rows").awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


@query
def stream_ingest(spark, sf_dir):
    """Two monitors on one store: the first sees a half of the texts as they arrive, the second the other half afterwards,
    and once more without its checkpoint."""
    path, arrived = shared_folder(spark, "monitor"), []
    target = Target(f"{path}/store", f"{path}/vault", crypto.key_table(spark, **DEMO_KEYS), "team", f"{path}/late")

    def run(texts: DataFrame, half: int, checkpoint: str) -> None:
        arrived.append(texts)
        of = F.pmod(F.xxhash64("content"), F.lit(2)) == half
        monitor(texts.filter(of), target, f"{path}/{checkpoint}", interval=None, delay="90 days").awaitTermination()

    _texts_arrive(spark, sf_dir, lambda texts: run(texts, 0, "first"), arrivals=2)
    for checkpoint in ("second", "lost"):
        run(arrived[-1], 1, checkpoint)
    return read_case_store(spark, target.store).select(
        "ingest_seq", "content_md5", "content_redacted", F.col("word_count").cast("long").alias("word_count"))


@query
def stream_dedupe(spark, sf_dir):
    path, rows = shared_folder(spark, "dedupe"), []
    _texts_arrive(spark, sf_dir, lambda texts: rows.append(_run_to_table(dedupe_seen(texts).select("content_md5"), path)))
    return rows[-1]


def _event_texts(events: DataFrame) -> DataFrame:
    """Events as texts of their user."""
    return events.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("ingest_seq"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("content"))


@query
def stream_changed(spark, sf_dir):
    """Events arrive out of order, by up to DISORDER places across micro-batches, and are compared in the order of their time."""
    path, rows = shared_folder(spark, "changed"), table(spark, sf_dir, "events")
    place = F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(DISORDER))
    # An event without a text ends the stream: it moves time past all others.
    end = rows.groupBy().agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(
        F.lit(None).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(1 << 62).alias("place"))
    arriving = rows.withColumn("place", place).unionByName(end, allowMissingColumns=True)
    _arrive(spark, arriving, "place", lambda events: stateful.changed_only(
        _event_texts(events), path, interval=None, delay="60 days").awaitTermination())
    return stateful.read_rows(spark, path).select(
        F.col("ingest_seq").alias("event_id"), F.col("source").cast("long").alias("user_id"))


@query
def stream_newest(spark, sf_dir):
    """Events whose type is not among the last ones that their user's memory holds; small limits, so that it is cut often."""
    path, rows = shared_folder(spark, "newest"), []

    def run(events: DataFrame) -> None:
        named = _event_texts(events).withColumn("content", F.concat_ws(" ", "content", F.col("ingest_seq") % NEWEST_KINDS))
        with stateful.rocksdb(spark):
            rows.append(_run_to_table(stateful.bounded_seen(named, most=NEWEST_MOST, kept=NEWEST_KEPT).select("ingest_seq", "source"), path))

    _arrive(spark, table(spark, sf_dir, "events"), "event_id", run)
    return rows[-1].select(F.col("ingest_seq").alias("event_id"), F.col("source").cast("long").alias("user_id"))


@query
def stream_tag_counts(spark, sf_dir):
    path = shared_folder(spark, "tags")

    def count(docs: DataFrame) -> None:
        cases = (docs.selectExpr("timestamp_seconds(1704067200 + doc_id) AS ts", f"{COLUMNS['content']} AS content")
                 .select("ts", X.tags(F.col("content")).alias("tags")))
        rollups.write_updates(rollups.tag_counts(cases), f"{path}/rows", f"{path}/checkpoint",
                              interval=None).awaitTermination()

    _arrive(spark, table(spark, sf_dir, "documents"), "doc_id", count)
    return rollups.read_counts(spark, f"{path}/rows").select(
        F.unix_seconds("start").alias("start"), "tag", "count")
