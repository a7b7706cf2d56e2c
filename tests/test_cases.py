import datetime as dt
import random

from pyspark.sql import functions as F

from caseflow.operators import cases as C

from . import reference_fold as ref

VAULT = "case_id string, ingest_seq bigint, mappings array<struct<token:string,original:string>>"


def history(spark, rows):
    return spark.createDataFrame(rows, "case_id string, ingest_seq bigint, summary string")


def test_last_write_wins_and_keeps_the_first_slot(spark):
    df = C.current_cases(history(spark, [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")]))
    assert {(r.case_id, r.ingest_seq, r.first_seq, r.summary) for r in df.collect()} == {
        ("a", 3, 1, "z"), ("b", 2, 2, "y")}


def test_a_hot_id_is_reduced_before_the_shuffle(spark):
    df = spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("case_id"),
        F.col("id").alias("ingest_seq"), F.lit("s").alias("summary"))
    result = C.current_cases(df)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan and "SortAggregate" not in plan
    assert result.filter("case_id = 'hot'").first().ingest_seq == 59_997 and result.count() == 40_001


def test_vault_keeps_the_last_non_empty_mappings(spark):
    one = [("[IP_1]", "1.1.1.1")]
    vault = spark.createDataFrame([("a", 1, one), ("a", 2, []), ("b", 3, [])], VAULT)
    assert [(r.case_id, r.ingest_seq) for r in C.current_vault(vault).collect()] == [("a", 1)]


def test_lookup_and_vault_joins(spark):
    cases = history(spark, [("a", 1, "x"), ("b", 2, "y"), ("c", 5, "z")])
    vault = spark.createDataFrame([("a", 1, [("t", "o")]), ("c", 4, [("t", "old")])], VAULT)
    assert [r.case_id for r in C.get_cases(cases, ["b", "nope"]).collect()] == ["b"]
    ids = spark.createDataFrame([("b",), ("b",), ("nope",)], "id string")
    assert [r.case_id for r in C.get_cases(cases, ids).collect()] == ["b"]
    assert {r.case_id for r in C.cases_with_pii(cases, vault).collect()} == {"a", "c"}
    assert {r.case_id for r in C.cases_without_pii(cases, vault).collect()} == {"b"}
    same = {r.case_id: r.mappings for r in C.with_mappings(cases, vault).collect()}
    assert same["c"] is None and same["a"][0].original == "o"
    assert {r.case_id: r.mappings for r in C.with_mappings(cases, vault, same_version=False).collect()}["c"]


def test_a_repeated_vault_write_does_not_multiply_cases(spark):
    cases = history(spark, [("a", 1, "x")])
    vault = spark.createDataFrame([("a", 1, [("t", "o")])] * 2, VAULT)
    for same_version in (True, False):
        assert C.with_mappings(cases, vault, same_version).count() == 1


def test_changed_only_keeps_rows_without_source_or_time(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, 1, start, "x"), (None, 2, start, "x"), (None, 3, start, "y"), ("a", 4, None, "x")],
                               "source string, ingest_seq bigint, ts timestamp, content string")
    assert sorted(r.ingest_seq for r in C.changed_only(df).collect()) == [1, 3, 4]


def test_first_copies(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "ingest_seq bigint, content string")
    assert {(r.ingest_seq, r.content, r.copies) for r in C.first_copies(df).collect()} == {(1, "x", 2), (2, "y", 1)}


def test_changed_only_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randint(1, 4)}", i, rng.choice(["a", "b", "", "c"]))
            for i in range(600)]
    start = dt.datetime(2024, 1, 1)
    data = [(s, i, start + dt.timedelta(minutes=7 * i), t) for s, i, t in rows]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "source string, ingest_seq bigint, ts timestamp, content string")
    got = sorted((r.source, r.ingest_seq, r.content) for r in C.changed_only(df).collect())
    assert got == sorted(ref.changed(rows))
