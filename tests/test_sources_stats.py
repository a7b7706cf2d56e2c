import json
import os

from pyspark.sql import functions as F

from caseflow.operators import parse, stats
from caseflow.operators.cases import current_cases
from caseflow.sources import files, store

from .test_parse import raw


def ingested(spark):
    return parse.ingest(raw(spark, "ICM-1: AMA timeout on Windows for a@b.co", "ICM-2: Linux timeout",
                            "ICM-1: AMA timeout on Windows is back"))


def test_case_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\ncase")
    (tmp_path / "b.txt").write_text("second")
    df = files.read_case_files(spark, str(tmp_path))
    assert {r.content for r in df.collect()} == {"first\ncase", "second"}
    assert df.select("ingest_seq").distinct().count() == 2 and parse.parse_case(df).count() == 2


def test_store_appends_and_reports_its_size(spark, tmp_path):
    path = str(tmp_path / "cases")
    assert store.store_size(spark, path) == 0
    done = parse.cases_of(ingested(spark))
    store.write_case_store(done.filter("ingest_seq = 1"), path)
    store.write_case_store(done.filter("ingest_seq > 1"), path)
    back = current_cases(store.read_case_store(spark, path))
    assert {(r.case_id, r.ingest_seq) for r in back.collect()} == {("ICM-1", 3), ("ICM-2", 2)}
    size = sum(f.stat().st_size for f in (tmp_path / "cases").rglob("*.parquet"))
    assert store.store_size(spark, path) >= size > 0


def test_json_store_both_ways(spark, tmp_path):
    done = current_cases(parse.cases_of(ingested(spark)))
    path = str(tmp_path / "json")
    store.export_case_store_json(done, path)
    back = store.read_case_store_json(spark, path, whole_file=False)
    assert back.filter("not readable").count() == 0
    left = {r.case_id: (r.summary, r.tags, r.word_count, r.created_at) for r in done.collect()}
    assert left == {r.case_id: (r.summary, r.tags, r.word_count, r.created_at) for r in back.collect()}


def test_json_store_of_one_object_and_a_damaged_file(spark, tmp_path):
    case = {"caseId": "A", "summary": "s", "symptoms": [], "environment": {"k": "v"}, "errorPatterns": [],
            "tags": ["t"], "contentRedacted": "c", "wordCount": 1, "createdAt": "2024-01-01T00:00:00.000Z",
            "updatedAt": "2024-01-01T00:00:00.000Z"}
    (tmp_path / "cases.json").write_text(json.dumps({"A": case, "B": {**case, "caseId": "B"}}, indent=2))
    (tmp_path / "broken.json").write_text("{not json")
    rows = store.read_case_store_json(spark, str(tmp_path)).collect()
    assert sorted(r.case_id for r in rows if r.readable) == ["A", "B"]
    assert [r.store_file.rsplit("/", 1)[1] for r in rows if not r.readable] == ["broken.json"]


def test_memory_store(spark):
    kept = store.memory_store(spark.range(3), "kept_cases", keep=True)
    assert spark.table("kept_cases").count() == 3
    kept.unpersist()


def test_stats(spark):
    done = ingested(spark)
    cases = current_cases(parse.cases_of(done))
    row = stats.stats(cases, parse.vault_of(done), data_size=7).first()
    assert (row.total_cases, row.cases_with_pii, row.data_size) == (2, 1, 7)
    assert [(t.tag, t["count"]) for t in row.top_tags] == [("Timeout", 2), ("AMA", 1), ("Windows", 1), ("Linux", 1)]
    assert stats.total_cases(parse.cases_of(done)).first().total_cases == 2
    none = stats.stats(cases.filter("false"), parse.vault_of(done).filter("false")).first()
    assert (none.total_cases, none.cases_with_pii, none.top_tags) == (0, 0, [])
    assert [tuple(r) for r in stats.top_tags(cases, 1).collect()] == [("Timeout", 2)]


def test_single_case(spark):
    done = parse.ingest(raw(spark, "ICM-301: Windows timeout"))
    assert stats.stats(current_cases(parse.cases_of(done)), parse.vault_of(done)).first().total_cases == 1
    assert done.select(F.size("mappings")).first()[0] == 0


def test_files_of_one_time_are_numbered_without_ties(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(300):
        (folder / f"note {n}+é.txt").write_text(f"text {n}")
        os.utime(folder / f"note {n}+é.txt", (1_700_000_000, 1_700_000_000))
    cases = files.read_case_files(spark, str(folder)).collect()
    assert len({c.ingest_seq for c in cases}) == len(cases) == 300


def test_stats_of_writes_equal_stats(spark):
    from caseflow.operators.cases import latest

    writes = spark.createDataFrame([("a", 1, ["x"], True), ("a", 3, ["y", "x"], False), ("b", 2, [], False), ("c", 4, ["y"], None)],
                                   "case_id string, ingest_seq bigint, tags array<string>, has_pii boolean")
    vault = writes.filter("has_pii").select("case_id", F.array(F.lit(1)).alias("mappings"))
    one, other = stats.stats_of_writes(writes, 7).first(), stats.stats(latest(writes.drop("has_pii")), vault, 7).first()
    assert one.asDict(True) == other.asDict(True)


def test_log_patterns_shuffle_hashes_with_the_cases(spark):
    from caseflow.operators.logs import log_pattern_counts

    df = spark.createDataFrame([("c1", "a\nb\na"), ("c2", "a")], "case_id string, content string")
    found = log_pattern_counts(df)
    assert {tuple(r) for r in found.collect()} == {("a", 3, 2), ("b", 1, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
