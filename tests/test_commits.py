import threading

import pytest

from caseflow.functions.crypto import key_table
from caseflow.operators.cases import current_cases
from caseflow.sources import commits
from caseflow.sources.store import read_case_store
from caseflow.sources.vault import read_vault
from caseflow.streaming.monitor import Target, monitor

from .test_streaming import arrive, note

ROWS = "ingest_seq bigint, content string"


@pytest.fixture
def target(spark, tmp_path):
    return Target(str(tmp_path / "store"), str(tmp_path / "vault"), key_table(spark, team="0f" * 32), "team")


def rows(spark, *numbers):
    return spark.createDataFrame([(n, f"text {n}") for n in numbers], ROWS)


def table(spark, path):
    return sorted(((r.batch_id, r.ingest_seq) for r in commits.read_batches(spark, path, f"{ROWS}, batch_id string").collect()), key=str)


def test_batches_are_whole_or_hidden(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == [] and commits.committed(spark, path) == []
    commits.write_batch(rows(spark, 1, 2), path, "a/b @ 1")
    commits.write_batch(rows(spark, 7), path, "c")
    rows(spark, 9).write.parquet(f"{path}/batch_id=c/attempt=wfailed")  # a writer that was lost before its commit
    rows(spark, 10).write.parquet(f"{path}/batch_id=d/attempt=wfailed")
    assert table(spark, path) == [("a/b @ 1", 1), ("a/b @ 1", 2), ("c", 7)]
    commits.write_batch(rows(spark, 3), path, "a/b @ 1")
    assert table(spark, path) == [("a/b @ 1", 3), ("c", 7)]
    commits.write_batch(rows(spark), path, "empty")
    commits.write_batch(rows(spark, None, 5), path, "null")
    assert [c.numbers for c in commits.committed(spark, path)] == ["3..3", "7..7", "none", "any"]
    assert len(table(spark, path)) == 4


def test_ranges_meet():
    def batch(numbers):
        return commits.Commit("b", 0, "w", numbers)

    assert batch("-5..9").may_hold("9..12") and not batch("-5..8").may_hold("9..12")
    assert batch("any").may_hold("1..1") and not batch("any").may_hold("none") and not batch("none").may_hold("any")


def test_writers_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "t")
    jobs = [threading.Thread(target=commits.write_batch, args=(rows(spark, n), path, f"b{n % 4}")) for n in range(8)]
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()
    found = table(spark, path)
    assert [b for b, _ in found] == ["b0", "b1", "b2", "b3"] and all(n % 4 == int(b[1]) for b, n in found)


def everything(spark, target):
    cases = sorted((r.case_id, r.ingest_seq) for r in read_case_store(spark, target.store).collect())
    originals = sorted(r.mappings[0].original for r in read_vault(spark, target.vault, target.keys).collect())
    return cases, originals


def of(*numbers):
    return [(f"ICM 60000000{n}", n) for n in numbers], [f"user{n}@example.com" for n in numbers]


def test_two_monitors_share_a_store(spark, tmp_path, target):
    first = arrive(spark, tmp_path / "a", [[("a", 1, note(1))], [("a", 3, note(3))]])
    second = arrive(spark, tmp_path / "b", [[("b", 2, note(2))], [("b", 4, note(4)), ("b", 5, note(5))]])
    for stream, checkpoint in ((first, "x"), (second, "y"), (first, "x")):
        monitor(stream, target, str(tmp_path / checkpoint), interval=None).awaitTermination()
    assert everything(spark, target) == of(1, 2, 3, 4, 5)


def test_a_lost_checkpoint_stores_nothing_twice(spark, tmp_path, target):
    stream = arrive(spark, tmp_path / "a", [[("a", 1, note(1)), ("a", 2, note(2))], [("a", 3, note(3))]])
    monitor(stream, target, str(tmp_path / "x"), interval=None).awaitTermination()
    more = arrive(spark, tmp_path / "a", [[("a", 4, note(4)), ("a", 5, "too short")]])
    monitor(more.filter("true"), target, str(tmp_path / "new"), interval=None).awaitTermination()
    assert everything(spark, target) == of(1, 2, 3, 4)
    assert current_cases(read_case_store(spark, target.store)).count() == 4


def test_a_repeated_or_half_written_batch_is_stored_once(spark, tmp_path, target):
    from caseflow.operators.parse import ingest
    from caseflow.sources.vault import write_ingested
    from caseflow.streaming.monitor import write_batch

    batch = (spark.createDataFrame([("a", n, None, None, note(n)) for n in (1, 2)],
                                   "source string, ingest_seq bigint, ts timestamp, given_case_id string, content string")
             .selectExpr("*", "md5(content) AS content_md5"))
    # The vault was committed, the store was not.
    write_ingested(ingest(batch), str(tmp_path / "elsewhere"), target.vault, target.keys, target.key_id, "q-0")
    for _ in range(3):
        write_batch(batch, 0, target, "q")
    assert everything(spark, target) == of(1, 2)
    assert [c.batch for c in commits.committed(spark, target.store)] == ["q-0"]
