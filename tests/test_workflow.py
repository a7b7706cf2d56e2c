import pytest

from caseflow import rules as R
from caseflow import workflow as W
from caseflow.functions.crypto import key_table
from caseflow.operators.cases import current_cases
from caseflow.operators.context import current_contexts, get_full
from caseflow.operators.governance import PiiFound
from caseflow.operators.parse import cases_of, ingest
from caseflow.policy import STRICT, TRUSTED, PolicyViolation
from caseflow.session import shared_folder
from caseflow.sources.store import read_case_store, write_case_store
from caseflow.sources.vault import read_vault

from .test_parse import raw


@pytest.fixture
def place(spark, tmp_path):
    return W.Paths(*[str(tmp_path / n) for n in ("store", "vault", "audit")]), key_table(spark, team="0f" * 32), tmp_path


def test_strict_add_and_export_leave_evidence(spark, place):
    paths, keys, folder = place
    W.add_cases(raw(spark, "ICM-1: mail a@b.co about the printer"), paths, keys, "team", STRICT)
    contexts = current_contexts(spark.read.parquet(paths.store))
    W.export_contexts(contexts, str(folder / "out"), paths, STRICT)
    audit = spark.read.parquet(paths.audit).collect()
    assert sorted((r.operation, r.case_id, r.tokens, r.pii_free) for r in audit) == [
        ("add", "ICM-1", 1, True), ("export", "ICM-1", 0, True)]
    assert "[EMAIL_1]" in spark.read.json(str(folder / "out")).first().content_preview
    assert spark.read.parquet(paths.vault).count() == 1


def test_a_repeated_batch_leaves_nothing_twice_and_two_writers_share_a_store(spark, place):
    paths, keys, folder = place
    for _ in range(2):
        W.add_cases(raw(spark, "ICM-1: mail a@b.co"), paths, keys, "team", STRICT, batch="one")
    write_case_store(cases_of(ingest(raw(spark, "ICM-2: mail c@d.eu"))), paths.store)
    stored = read_case_store(spark, paths.store)
    assert sorted(r.case_id for r in stored.collect()) == ["ICM-1", "ICM-2"]
    vault = read_vault(spark, paths.vault, keys)
    assert vault.count() == 1 and spark.read.parquet(paths.audit).count() == 1
    full = get_full(current_cases(stored), vault.unionByName(vault), ["ICM-1"], TRUSTED).collect()
    assert [r.content_full for r in full] == ["ICM-1: mail a@b.co"]


def test_trusted_keeps_no_audit(spark, place):
    paths, keys, folder = place
    W.add_cases(raw(spark, "ICM-1: nothing personal"), paths, keys, "team", TRUSTED)
    assert not (folder / "audit").exists()


def test_strict_refuses_raw_fields_and_dirty_exports(spark, place):
    paths, keys, folder = place
    with pytest.raises(PolicyViolation):
        W.add_cases(raw(spark, "x"), paths, keys, "team", STRICT, fields="raw")
    for rules in ((), R.PII_RULES[:3]):
        with pytest.raises(PolicyViolation):
            W.add_cases(raw(spark, "ICM-1: mail a@b.co"), paths, keys, "team", STRICT, rules=rules)
    W.add_cases(raw(spark, "ICM-1: touching 10.0.0.1server=a"), paths, keys, "team", STRICT)
    contexts = current_contexts(spark.read.parquet(paths.store))
    with pytest.raises(PiiFound):
        W.export_contexts(contexts, str(folder / "out"), paths, STRICT)
    assert not (folder / "out").exists()


def test_shared_folder_follows_the_setting(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        assert shared_folder(spark, "x").rsplit("/", 1)[0] == shared_folder(spark, "y").rsplit("/", 1)[0]
