import pytest

from caseflow.operators import grams as G
from caseflow.operators import search as S
from caseflow.operators.cases import current_cases
from tests.test_search import SCHEMA

SCHEMA = SCHEMA.replace(", first_seq bigint", "")
LONG = "a" * 200_000 + " needle " + "\u00e9\U0001f600x\n" * 3


@pytest.fixture(scope="module")
def writes(spark):
    return spark.createDataFrame([
        ("ICM-1", "Backup timeout at night", ["Queue is FULL"], {}, [], ["Windows"], "job timeout at two", "", 1),
        ("ICM-2", "Linux printer offline", [], {}, ["abc", "def"], ["Linux"], "the linux queue stopped", "", 2),
        ("ICM-1", "Backup runs again", [None, ""], {}, [], ["Windows"], "all is well", "", 3),
        ("ICM-4", None, None, None, None, None, None, "", 4),
        ("ICM-5", "", [], {}, [], [], LONG, "", 5),
        (None, "timeout without an id", [], {}, [], [], "", "", None),
    ], SCHEMA).withColumn("gram", G.F.lit("x")).withColumn("wanted", G.F.lit(1)).withColumn("bit", G.F.lit(1))


@pytest.fixture(scope="module")
def index(writes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    early = G.F.coalesce(G.F.col("ingest_seq"), G.F.lit(0)) < 3
    G.index_writes(writes.filter(early), path, "early")
    G.index_writes(writes.filter(~early), path, "late")
    G.index_writes(writes.filter(~early), path, "late")
    return path


PHRASES = ["timeout", "QUEUE", "x", "", "ab", "needle", "e \u00e9", "\u00c9\U0001f600", "\U0001f600x\n", "aaaa", "cde", "abcdef",
           "backup", "no such text", "needle needle", "timeout"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"limit": 1}, {"accumulate": True}])
def test_equals_the_search_of_every_text(writes, index, options):
    cases = current_cases(writes)
    assert rows(G.search_indexed(cases, index, PHRASES, **options)) == rows(S.search_batch(cases, PHRASES, **options))
    long_ones = [p for p in PHRASES if len(p) > 2]
    assert rows(G.search_indexed(cases, index, long_ones)) == rows(S.search_batch(cases, long_ones))


def test_trigrams_of_one_field_only(spark):
    one = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,), ("aaaa",)], "t string")
    assert [r[0] for r in one.select(G.grams_of(G.F.col("t"))).collect()] == [["abc", "bcd"], [], [], [], ["aaa", "aaa"]]


def test_only_writes_with_the_phrase_are_candidates(spark, index):
    found = {(len(r.wanted), r.wanted[0].query) for r in G.candidates(spark, index, ["linux queue", "zzz", "ab"]).collect()}
    assert found == {(1, "linux queue")}


def test_a_repeated_batch_leaves_each_posting_once(spark, index, writes):
    stored = G.read_batches(spark, f"{index}/postings", G.POSTINGS)
    assert stored.count() == stored.distinct().count() == G.postings(writes).count()


def test_folders_of_other_trigrams_are_not_read(spark, index):
    few = G._of(G.read_batches(spark, f"{index}/postings", G.POSTINGS), {(G.PARTS - 1, "qqq")})
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters" in plan


def test_empty_tables_and_bad_arguments(spark, writes, tmp_path):
    path = str(tmp_path / "none")
    cases = current_cases(writes)
    assert rows(G.search_indexed(cases, path, ["timeout"])) == []
    G.index_writes(writes.limit(0), path, "none")
    assert rows(G.search_indexed(cases.limit(0), path, ["timeout", "a"])) == []
    with pytest.raises(ValueError):
        G.search_indexed(cases, path, [])
    with pytest.raises(ValueError):
        G.search_indexed(cases, path, ["a"], limit=-1)
