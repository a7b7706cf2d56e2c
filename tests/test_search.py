import pytest

from caseflow.operators import search as S
from caseflow.operators.cases import current_cases

SCHEMA = ("case_id string, summary string, symptoms array<string>, environment map<string,string>, "
          "error_patterns array<string>, tags array<string>, content_redacted string, created_at string, "
          "ingest_seq bigint, first_seq bigint")


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([
        ("ICM-1", "Backup timeout at night", [], {}, [], ["Windows", "Timeout"], "job timeout at two", "", 1, 1),
        ("ICM-2", "Linux printer offline", [], {}, [], ["Linux", "Connection"], "the linux queue stopped", "", 2, 2),
        ("ICM-3", "Slow shared drive", [], {}, ["DriveException timeout"], ["Azure"], "", "", 3, 3),
    ], SCHEMA)


def found(df):
    return [(r.case_id, r.score, r.matches) for r in df.collect()]


def test_weights_and_order(cases):
    assert found(S.search(cases, "timeout")) == [
        ("ICM-1", 18, ["summary", "tags", "content"]), ("ICM-3", 9, ["errors"])]
    assert found(S.search(cases, "LINUX")) == [("ICM-2", 18, ["summary", "tags", "content"])]
    assert found(S.search(cases, "zyxwvuts")) == []


def test_empty_phrase_is_in_every_text_and_ties_keep_store_order(cases):
    assert [(i, s) for i, s, _ in found(S.search(cases, ""))] == [("ICM-3", 27), ("ICM-1", 18), ("ICM-2", 18)]


def test_limit(cases):
    assert len(found(S.search(cases, "timeout", limit=1))) == 1
    assert found(S.search(cases, "timeout", limit=0)) == []
    with pytest.raises(ValueError):
        S.search(cases, "timeout", limit=-1)


def test_accumulate_counts_every_matching_element(cases):
    assert [(i, s) for i, s, _ in found(S.search(cases, "", accumulate=True))] == [
        ("ICM-3", 27), ("ICM-1", 23), ("ICM-2", 23)]


def test_batch_equals_single_searches_also_in_several_passes_and_large_limits(cases):
    phrases = ["timeout", "linux", "", "none at all", "a"]
    single = [(n, p, i + 1, *row) for n, p in enumerate(phrases) for i, row in enumerate(found(S.search(cases, p)))]
    for options in ({}, {"per_pass": 2}, {"limit": 5000}):
        batch = S.search_batch(cases, phrases, **options).orderBy("query_no", "rank")
        assert [(r.query_no, r.query, r.rank, r.case_id, r.score, r.matches) for r in batch.collect()] == single


def test_batch_never_pairs_cases_with_phrases(cases):
    plan = S.search_batch(cases, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_history_search_looks_at_the_last_write_only(spark, cases):
    rewritten = cases.filter("case_id = 'ICM-1'").selectExpr(
        "case_id", "'now about disks' as summary", "symptoms", "environment", "error_patterns", "array() as tags",
        "'' as content_redacted", "created_at", "cast(9 as bigint) as ingest_seq", "first_seq")
    history = cases.unionByName(rewritten).drop("first_seq")
    assert found(S.search_history(history, "timeout")) == [("ICM-3", 9, ["errors"])]
    assert found(S.search_history(history, "disks")) == [("ICM-1", 10, ["summary"])]
    for phrase in ("timeout", "disks", "linux", ""):
        assert found(S.search_history(history, phrase)) == found(S.search(current_cases(history), phrase))


def test_history_search_shuffles_no_text(spark, cases):
    plan = S.search_history(cases.drop("first_seq"), "timeout")._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "content_redacted" not in plan[:exchange]
