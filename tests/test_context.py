import json

import pytest
from pyspark.sql import functions as F

from caseflow.operators import context as K
from caseflow.operators import parse
from caseflow.operators import search as S
from caseflow.operators.cases import current_cases
from caseflow.policy import STRICT, TRUSTED, PolicyViolation, policy
from caseflow.sources.files import context_json, export_context_json

from .test_parse import raw


@pytest.fixture(scope="module")
def done(spark):
    texts = ["ICM-200: slow disks in West Europe, reported by a@b.co", "ICM-301: Windows timeout again and again",
             "ICM-400: long " + "x" * 600]
    return parse.ingest(raw(spark, *texts)).persist()


@pytest.fixture(scope="module")
def cases(done):
    return current_cases(parse.cases_of(done))


def test_preview_is_cut_only_when_longer(cases):
    rows = {r.case_id: r for r in K.to_case_context(cases).collect()}
    assert len(rows["ICM-400"].content_preview) == 503 and rows["ICM-400"].content_preview.endswith("...")
    assert rows["ICM-301"].content_preview == "ICM-301: Windows timeout again and again"
    always = {r.case_id: r for r in K.to_case_context(cases, always_ellipsis=True).collect()}
    assert always["ICM-301"].content_preview.endswith("again...")


def test_export_keeps_order_and_repeats_and_drops_unknown_ids(cases):
    pack = K.export_context(cases, ["ICM-301", "nope", "ICM-200", "ICM-301"]).first()
    assert pack.context_type == "support_cases" and pack.total_cases == 3
    assert [c.case_id for c in pack.cases] == ["ICM-301", "ICM-200", "ICM-301"]
    assert pack.generated_at.endswith("Z") and len(pack.generated_at) == 24


def test_empty_export(cases):
    pack = K.export_context(cases, ["nope"]).first()
    assert pack.total_cases == 0 and pack.cases == []


def test_json_export(cases, tmp_path):
    pack = K.export_context(cases, ["ICM-200"], F.timestamp_seconds(F.lit(0)))
    document = json.loads(context_json(pack).first().json)
    assert document["generated_at"] == "1970-01-01T00:00:00.000Z" and document["cases"][0]["case_id"] == "ICM-200"
    export_context_json(pack, str(tmp_path / "pack"))


def test_render(cases):
    found = K.search_rows(S.search(cases, "timeout", with_context=True))
    assert K.render_search(found, "timeout").first().text == (
        'Found 1 similar cases for: "timeout"\n\n**ICM-301**: ICM-301: Windows timeout again and again\n'
        "Tags: Windows, Timeout\nKey symptoms: \n")
    none = K.search_rows(S.search(cases, "zyxwvuts", with_context=True))
    assert K.render_search(none, "q").first().text == 'Found 0 similar cases for: "q"\n\n'
    text = K.render_context(K.export_rows(K.to_case_context(cases), ["ICM-301", "ICM-301"])).first().text
    assert text.startswith("**Support Case Context for Analysis:**\n\n## Case ICM-301\n") and text.count("\n---\n\n") == 1


def test_policy_profiles():
    assert policy("strict") is STRICT and policy("trusted") is TRUSTED
    assert (STRICT.require_redaction, STRICT.allow_full_rehydration, STRICT.encrypt_vault, STRICT.audit_log,
            STRICT.outbound_scrub) == (True, False, True, True, True)
    assert (TRUSTED.require_redaction, TRUSTED.allow_full_rehydration, TRUSTED.encrypt_vault, TRUSTED.audit_log,
            TRUSTED.outbound_scrub) == (True, True, True, False, False)
    with pytest.warns(UserWarning):
        assert policy("enterprise") is TRUSTED


def test_full_view_follows_the_policy(done, cases):
    vault = parse.vault_of(done)
    full = {r.case_id: r.content_full for r in K.get_full(cases, vault, ["ICM-200", "ICM-301"], TRUSTED).collect()}
    assert full == {"ICM-200": "ICM-200: slow disks in West Europe, reported by a@b.co", "ICM-301": None}
    with pytest.raises(PolicyViolation, match="not permitted"):
        K.get_full(cases, vault, ["ICM-200"], STRICT)
    assert K.get_full(cases, vault, ["ICM-301"], STRICT).count() == 1
    assert K.get_full(cases, vault, ["ICM-200"], STRICT, context=True).columns == list(K.CONTEXT_COLUMNS)


def test_contexts_of_a_history_shuffle_no_text(done):
    contexts = K.current_contexts(parse.cases_of(done))
    plan = contexts._jdf.queryExecution().executedPlan().toString()
    assert "content_redacted" not in plan[:plan.index("Exchange")]
    assert contexts.count() == 3


def test_a_document_with_too_many_contexts_is_an_error(spark, monkeypatch):
    rows = spark.range(6).selectExpr(
        "id AS pos", "string(id) AS case_id", "'s' AS summary", "array('x') AS symptoms", "map('os', 'Linux') AS environment",
        "array('e') AS key_errors", "array('t') AS tags", "'p' AS content_preview")
    monkeypatch.setattr(K, "MOST_IN_DOCUMENT", 6)
    documents = [K.context_pack(rows).selectExpr("string(total_cases) AS text"), K.render_context(rows), K.render_search(rows, "q")]
    assert documents[0].first().text == "6" and all(d.first().text for d in documents[1:])
    monkeypatch.setattr(K, "MOST_IN_DOCUMENT", 5)
    for document in (K.context_pack(rows), K.render_context(rows), K.render_search(rows, "q")):
        with pytest.raises(Exception, match="more than 5 contexts"):
            document.collect()
