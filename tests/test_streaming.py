import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from caseflow.functions import fields as X
from caseflow.functions.crypto import key_table
from caseflow.operators.cases import first_copies
from caseflow.operators.parse import ingest
from caseflow.plans import queries
from caseflow.sources.files import read_case_files, stream_case_files
from caseflow.sources.store import read_case_store
from caseflow.sources.vault import read_vault
from caseflow.streaming import rollups, stateful
from caseflow.streaming.monitor import Target, dedupe_seen, keep_running, monitor, valid_content, write_batch

from . import reference_fold as ref

RAW = "source string, ingest_seq bigint, ts timestamp, given_case_id string, content string"
START = dt.datetime(2024, 1, 1)
LONG = " reported by a customer whose machine is out of order since yesterday"


def arrive(spark, folder, batches):
    """Write each batch as one file; a stream that takes one file at a time sees them in order."""
    for n, rows in enumerate(batches):
        data = [(s, i, START + dt.timedelta(minutes=i), None, t) for s, i, t in rows]
        df = spark.createDataFrame(data, RAW).coalesce(1)
        df.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, folder):
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
     .trigger(availableNow=True).start(f"{folder}/out").awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@pytest.fixture
def target(spark, tmp_path):
    return Target(str(tmp_path / "store"), str(tmp_path / "vault"), key_table(spark, team="0f" * 32), "team")


def note(n):
    return f"ICM 60000000{n}: problem {n}{LONG}, mail user{n}@example.com"


def test_monitor_equals_the_batch_result(spark, tmp_path, target):
    batches = [[("a", 1, note(1)), ("b", 2, note(2)), ("a", 3, note(1)), ("a", 4, "too short")],
               [("c", 5, note(2)), ("a", 6, note(3)), ("a", 7, "no indicator " * 9)], [("a", 8, note(1))]]
    stream = arrive(spark, tmp_path / "in", batches)
    monitor(stream, target, str(tmp_path / "cp"), interval=None).awaitTermination()
    stored = spark.read.parquet(target.store)
    everything = spark.read.parquet(str(tmp_path / "in"))
    expected = ingest(first_copies(valid_content(everything)))
    assert (sorted((r.content_redacted, r.summary) for r in stored.collect())
            == sorted((r.content_redacted, r.summary) for r in expected.collect()))
    assert {r.case_id for r in stored.collect()} == {"ICM 600000001", "ICM 600000002", "ICM 600000003"}
    vault = read_vault(spark, target.vault, target.keys)
    assert sorted(r.mappings[0].original for r in vault.collect()) == [f"user{n}@example.com" for n in (1, 2, 3)]


def test_a_repeated_batch_leaves_the_same_files(spark, target):
    rows = [("a", i, START, None, note(i)) for i in (1, 2)]
    first, second = spark.createDataFrame(rows[:1], RAW), spark.createDataFrame(rows, RAW)
    write_batch(first, 0, target)
    write_batch(second, 1, target)
    write_batch(second, 1, target)
    stored = read_case_store(spark, target.store)
    assert sorted((r.ingest_seq, r.batch_id) for r in stored.collect()) == [(1, "0"), (1, "1"), (2, "1")]
    assert read_vault(spark, target.vault, target.keys).count() == 3


def test_files_in_a_folder_become_cases(spark, tmp_path, target):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(note(1))
    stream = stream_case_files(spark, str(tmp_path / "in"), max_files=1)
    monitor(stream, target, str(tmp_path / "cp"), interval=None).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text(note(2))
    (tmp_path / "in" / "c.txt").write_text(note(1))
    monitor(stream, target, str(tmp_path / "cp"), interval=None).awaitTermination()
    assert spark.read.parquet(target.store).count() == 2


def test_dedupe_seen_across_batches(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[("a", 1, "x"), ("a", 2, "x")], [("b", 3, "x"), ("b", 4, "y")]])
    assert sorted(r.content for r in run(dedupe_seen(stream), tmp_path).collect()) == ["x", "y"]


def test_dedupe_seen_keeps_late_texts(spark, tmp_path):
    batches = [[("a", 5000, "new")], [("a", 1, "old")], [("b", 2, "older"), ("b", 3, "new")], [("b", 4, "old")]]
    assert sorted(r.content for r in run(dedupe_seen(arrive(spark, tmp_path / "in", batches)), tmp_path).collect()) == [
        "new", "old", "older"]


@pytest.mark.parametrize("delay", ["10 minutes", "1 minute"])
def test_changed_only_across_batches(spark, tmp_path, delay):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice(["x", "y", ""])) for i in range(60)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))
    stream = arrive(spark, tmp_path / "in", [mixed[:20], mixed[20:40], mixed[40:], [("a", 9999, "")]])
    stateful.changed_only(stream, str(tmp_path / "out"), interval=None, delay=delay).awaitTermination()
    late = {r.ingest_seq for r in stateful.read_late(spark, str(tmp_path / "out")).collect()}
    assert bool(late) == (delay == "1 minute")
    got = sorted((r.source, r.ingest_seq) for r in stateful.read_rows(spark, str(tmp_path / "out")).collect())
    assert got == sorted((s, i) for s, i, _ in ref.changed([r for r in rows if r[1] not in late]))


def stateful_run(stream, folder):
    """The rows that a stateful query writes, and what its state held after each batch."""
    with stateful.rocksdb(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
                 .trigger(availableNow=True).start(f"{folder}/out"))
    query.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect(), held


def test_texts_are_remembered_for_the_delay(spark, tmp_path):
    batches = [[("a", 20, "x"), ("a", 15, "x"), ("b", 16, "y")], [("a", 21, "x"), ("a", 30, "z")],
               [("a", 200, "w"), ("a", 29, "x"), ("a", 201, "x")], [("b", 22, "q"), ("a", 202, "w"), ("a", 203, None)]]
    rows, _ = stateful_run(stateful.earliest_within(arrive(spark, tmp_path / "in", batches), "30 minutes"), tmp_path)
    fresh = sorted((r.ingest_seq, r.content) for r in rows if not r.late)
    # Of the copies in the third batch none is late yet; in the fourth, what is older than 171 minutes is.
    assert fresh == [(15, "x"), (16, "y"), (30, "z"), (200, "w"), (203, None)]
    assert sorted(r.ingest_seq for r in rows if r.late) == [22]
    assert {r.content_md5 for r in rows if r.content == "q"} == {"7694f4a66316e53c8cdd9d9954bd611d"}


def test_the_state_of_seen_texts_does_not_grow(spark, tmp_path):
    batches = [[("a", 10 * n + k, f"text {10 * n + k // 2}") for k in range(10)] for n in range(20)]
    rows, held = stateful_run(stateful.earliest_within(arrive(spark, tmp_path / "in", batches), "15 minutes"), tmp_path)
    assert len(rows) == 100 and not any(r.late for r in rows)
    assert max(held[4:]) <= max(held[:5]) + 2 and held[-1] < 60


def newest(rows, most, kept):
    """The hand-made form: one list per source."""
    memory = {}
    for source, number, text in rows:
        held = memory.setdefault(source, [])
        if text not in held:
            yield number
            held.append(text)
            if len(held) > most:
                del held[:-kept]


def test_the_newest_texts_of_a_source(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, rng.choice("pqrstuvw")) for i in range(90)]
    batches = [rng.sample(rows[n:n + 30], 30) for n in (0, 30, 60)]
    found, _ = stateful_run(stateful.bounded_seen(arrive(spark, tmp_path / "in", batches), most=4, kept=2), tmp_path)
    assert sorted(r.ingest_seq for r in found) == sorted(newest(rows, 4, 2))
    parted, _ = stateful_run(stateful.bounded_seen(arrive(spark, tmp_path / "in2", batches), parts=16), tmp_path / "2")
    assert len(parted) == len({(s, t) for s, _, t in rows})


def test_the_columns_of_a_row_come_back_as_they_were(spark, tmp_path):
    big = 2**62 + 1
    data = [(None, big, START, None, "t"), ("a", None, None, "g", None), ("a", big + 2, START + dt.timedelta(microseconds=7), None, "t")]
    plain = spark.createDataFrame(data, RAW).selectExpr(
        "*", "IF(content IS NULL, NULL, array(1L, NULL, 9007199254740993L)) AS `a list`", "double('NaN') AS _d", "ts AS us", "ingest_seq AS number",
        "decode(unhex('c3a9'), 'UTF-8') AS part", "IF(ingest_seq IS NULL, X'00ff', NULL) AS bytes", "TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS ntz")
    plain.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(plain.schema).parquet(str(tmp_path / "in"))
    bounded = stateful.bounded_seen(stream)
    found, _ = stateful_run(bounded, tmp_path)
    assert bounded.columns == [*plain.columns, "content_md5"]
    assert sorted(map(repr, found)) == sorted(map(repr, plain.withColumn("content_md5", F.md5("content")).collect()))


def test_many_sources_share_a_key_of_the_state(spark, tmp_path):
    rows = [[(f"s{n}", n + 4000 * k, "xy"[n % 2]) for n in range(4000)] for k in range(2)]
    bounded, held = stateful_run(stateful.bounded_seen(arrive(spark, tmp_path / "in", rows)), tmp_path / "newest")
    assert len(bounded) == 4000 and max(held) <= 4 * stateful.BUCKETS
    changed, held = stateful_run(stateful.changes(spark.readStream.schema(RAW).parquet(str(tmp_path / "in")), "60 days"), tmp_path / "changes")
    assert not changed and max(held) <= 4 * stateful.BUCKETS


def test_a_silent_source_is_forgotten(spark, tmp_path):
    batches = [[("a", 1, "x"), ("b", 2, "x")], [("b", 20, "x")], [("b", 40, "x")], [("a", 41, "x"), ("b", 42, "x")], [("c", 999, "x")], [("c", 1000, "x")]]
    found, held = stateful_run(stateful.bounded_seen(arrive(spark, tmp_path / "in", batches), idle="30 minutes"), tmp_path)
    assert sorted(r.ingest_seq for r in found) == [1, 2, 41, 999] and held[-1] < held[1]


def test_changes_of_unnamed_sources_and_large_numbers(spark, tmp_path):
    big, at = 2**62 + 1, lambda m: START + dt.timedelta(minutes=m)
    data = [[(None, big, at(5), "x"), ("", big, at(5), "x"), (None, None, at(5), "y"), ("a", 1, None, "x"), ("a", 2, at(0), None)],
            [(None, big + 2, at(6), "x"), ("", big + 2, at(6), "x"), ("", big + 4, at(60), "y")],
            [("", big + 1, at(5), "z"), ("b", 3, at(500), "")], [("b", 4, at(1), "late")]]
    for rows in data:
        spark.createDataFrame([(s, i, t, None, x) for s, i, t, x in rows], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found, _ = stateful_run(stateful.changes(stream, "100 minutes"), tmp_path)
    known = {(r.source, r.ingest_seq, r.ts) for r in found if not r.late}
    # Without a number comes first: y, x for the unnamed source; x, z, x, y for the empty name, as big + 1 is after big.
    assert known == {(None, None, at(5)), (None, big, at(5)), ("", big, at(5)), ("", big + 1, at(5)), ("", big + 2, at(6)), ("", big + 4, at(60))}
    assert {(r.source, r.ingest_seq, r.ts) for r in found if r.late} == {("a", 1, None), ("b", 4, at(1))}


def test_tag_counts_keep_the_latest_update(spark, tmp_path):
    rows = [[("a", 1, "x"), ("a", 2, "x")], [("a", 3, "x"), ("a", 14, "y")]]
    stream = arrive(spark, tmp_path / "in", rows).withColumn("tags", F.array("content"))
    rollups.write_updates(rollups.tag_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"),
                          interval=None).awaitTermination()
    counts = rollups.read_counts(spark, str(tmp_path / "out"))
    assert {(r.start, r.tag, r["count"]) for r in counts.collect()} == {
        (START, "x", 3), (START + dt.timedelta(minutes=10), "y", 1)}


def test_a_failed_run_is_started_again_and_repeats_its_batch(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[("a", 1, "x")], [("a", 2, "y")]])
    seen, failures = [], [True]

    def write(batch, batch_id):
        if batch_id == 1 and failures:
            failures.pop()
            raise RuntimeError("lost")
        seen.extend(r.content for r in batch.collect())

    def start():
        return (stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp"))
                .trigger(availableNow=True).start())

    assert keep_running(start, interval=0.01) == 1
    assert sorted(seen) == ["x", "y"]


def documents(spark, folder, ids):
    """A table of documents, one text each, in several files."""
    rows = [(i, f"{note(n)} of the batch", "en", "s1", 0) for n, i in enumerate(ids)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_table_arrives_whole_in_order_and_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ARRIVALS", 3)
    ids = [*range(120), 10**12, None, None]  # uneven, and two without an id
    batches = []

    def run(stream):
        (stream.select("doc_id", F.input_file_name().alias("file")).writeStream.foreachBatch(lambda batch, n: batches.append(
            ([r.doc_id for r in batch.collect()], len({r.file for r in batch.collect()}))))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())

    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task per file
    try:
        queries._arrive(spark, spark.read.parquet(f"{documents(spark, tmp_path / 't', ids)}/documents.parquet"), "doc_id", run)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(batches) == 3 and sorted((i for b, _ in batches for i in b), key=str) == sorted(ids, key=str)
    assert batches[0][0].count(None) == 2 and all(files > 1 and len(b) > 30 for b, files in batches)
    found = [sorted(-1 if i is None else i for i in b) for b, _ in batches]
    assert all(a[-1] < b[0] for a, b in zip(found, found[1:]))


def test_stream_queries_keep_texts_without_an_id_and_take_empty_tables(spark, tmp_path):
    some, none = documents(spark, tmp_path / "some", [1, 2, 900, None, None]), documents(spark, tmp_path / "none", [])
    assert queries.stream_dedupe(spark, some).count() == 5 and queries.stream_dedupe(spark, none).count() == 0
    assert queries.stream_tag_counts(spark, none).count() == 0


def test_files_of_one_time_get_numbers_of_their_own(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(names):
        for name in names:
            (folder / name).write_text(name)
            os.utime(folder / name, (1_700_000_000, 1_700_000_000))

    put([f"f{k:04}.txt" for k in range(1500)])
    out = str(tmp_path / "out")

    def run():
        stream = stream_case_files(spark, str(folder)).select("source", "ingest_seq", "content")
        with stateful.rocksdb(spark):
            return queries._run_to_table(stream, out)

    first = {r.content: r.ingest_seq for r in run().collect()}
    assert first == {r.content: r.ingest_seq for r in read_case_files(spark, str(folder)).collect()}
    put([f"e{k:04}.txt" for k in range(1500)])
    both = [(r.ingest_seq, r.content) for r in run().collect()]
    assert len(both) == len({n for n, _ in both}) == 3000 and max(first.values()) + 1 in {n for n, t in both if t == "e0000.txt"}
    assert len({r.ingest_seq for r in read_case_files(spark, str(folder)).collect()}) == 3000


def test_the_suggested_id_is_looked_for_alone(spark, tmp_path, monkeypatch):
    texts = ["Ticket: AB12CD34 and Case 12345678", "Teams call 123456789, ICM: 87654321", "no id here", "SR 2400000001 Incident-10000007", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, content string")
    chosen = F.get(X.detect_case_ids(F.col("content")), 0)
    before = {r.ingest_seq: r.id for r in df.select("ingest_seq", chosen.alias("id")).collect()}
    monkeypatch.delattr(X, "detect_case_ids")
    rows = df.filter("content IS NOT NULL").selectExpr("'s' AS source", "ingest_seq", "timestamp_seconds(1) AS ts", "CAST(NULL AS string) AS given_case_id", "content")
    write_batch(rows, 0, Target(f"{tmp_path}/store", f"{tmp_path}/vault", key_table(spark, team="0f" * 32), "team"))
    stored = {r.ingest_seq: r.case_id for r in read_case_store(spark, f"{tmp_path}/store").collect()}
    assert {n: i if i and not i.startswith("CASE-") else None for n, i in stored.items()} == {n: i for n, i in before.items() if n != 4}
