import json
import pathlib
import random

import pytest

from caseflow.plans import queries as Q
from caseflow.sources import store
from caseflow.sources.objects import object_entries


def case(name, text):
    return {"caseId": name, "summary": text, "symptoms": [text], "environment": {"{": "}", "k": text}, "errorPatterns": [],
            "tags": ["t"], "contentRedacted": text, "wordCount": 1, "createdAt": "2024-01-01T00:00:00.000Z",
            "updatedAt": "2024-01-01T00:00:00.000Z"}


@pytest.mark.parametrize("range_bytes", ["500", "128m"])
def test_ranges_give_every_entry(spark, tmp_path, range_bytes):
    rng = random.Random(6)
    atoms = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "𝒳", "a", " ", '\\"', "}}", '{"x": {']
    expected = {}
    for number, indent in enumerate((None, 2, "\t")):
        entries = {f"{number} {k} {rng.choice(atoms)}": "".join(rng.choices(atoms, k=rng.randint(0, 60))) for k in range(40)}
        expected |= entries
        text = json.dumps({k: case(k, t) for k, t in entries.items()}, indent=indent, ensure_ascii=number == 1)
        (tmp_path / f"{number}.json").write_text(text + "\n" * number)
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = store.read_case_store_json(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(r.readable for r in rows) and len(rows) == 120
    assert {r.case_id: r.content_redacted for r in rows} == expected
    assert all(r.symptoms == [r.content_redacted] and r.environment == {"{": "}", "k": r.content_redacted} for r in rows)
    assert sorted(r.slot for r in rows if r.case_id[0] == "0") == list(range(40))


def test_files_that_are_no_whole_objects(spark, tmp_path):
    good = json.dumps({"A": case("A", "t"), "B": case("B", "t")}, indent=2)
    texts = {"empty": "", "blank": " \n", "none": "{}", "spaced": "{ \n }\n", "cut": good[:good.index('"B"') + 30], "open": '{"A": {',
             "broken": "{not json", "whole": good, "list": "[1, 2]", "number": '{"n": 5, "A": {"caseId": "A"}}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = store.read_case_store_json(spark, str(tmp_path)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.store_file.rsplit("/", 1)[1][:-5], []).append((r.case_id, r.readable))
    assert {k: sorted(v, key=str) for k, v in found.items() if k != "number"} == {
        "cut": [("A", True), (None, False)], "open": [(None, False)], "broken": [(None, False)], "list": [(None, False)],
        "whole": [("A", True), ("B", True)]}
    assert object_entries(spark, str(tmp_path / "none.json")).count() == 0


def test_a_larger_table_is_dealt_to_more_objects(spark, tmp_path, monkeypatch):
    spark.range(120).selectExpr("id AS doc_id", "'some words ' || id AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q, "DOCS_PER_OBJECT", 2)
    folders = []
    monkeypatch.setattr(Q, "shared_folder", lambda _, name: folders.append(f"{tmp_path}/{name}") or folders[-1])
    rows = Q.QUERIES["case_store_object"](spark, str(tmp_path))
    assert rows.count() == rows.select("case_id").distinct().count() > 80
    assert len(list(pathlib.Path(folders[0]).glob("part-*"))) > Q.OBJECTS
